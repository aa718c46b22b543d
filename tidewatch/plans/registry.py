"""Registry of named checks: a Spark query over the test tables and, where the
operator is SQL-expressible, an independent DuckDB SQL statement that must
return the same rows (the correctness gate of ``__spark_entry__``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.functions.exprs import present

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, raw: bool = False):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df if raw else present(df)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    # importing the modules fills the registry
    from tidewatch.plans import (q_eval, q_missing, q_models, q_plans, q_prep, q_profile,  # noqa: F401
                                 q_sources)


def ts_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def floor_sql(expr: str, seconds: int) -> str:
    """Epoch-origin tumbling window start in DuckDB."""
    us = seconds * 1_000_000
    return f"make_timestamp(cast(floor(epoch_us({expr}) / {us}) as bigint) * {us})"


def r6(expr: str) -> str:
    return f"(round(cast({expr} as double) * 1e6 + 0.00737) / 1e6)"


def qi(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def r6list(expr: str) -> str:
    return f"list_transform({expr}, lambda x: (round(cast(x as double) * 1e6 + 0.00737) / 1e6))"
