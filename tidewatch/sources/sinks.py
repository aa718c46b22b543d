"""Sinks (A8-A11): metrics, anomaly tables and profile tables.

Writes are distributed (one file per task); nothing is collected to the
driver.  Profile tables are stored together with the population profile so
that scoring works after a reload (R9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.profile import wide_profiles

REPORT_COLUMNS = ["entity", "anomaly_score", "num_anomalous_features", "total_features"]


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"Unsupported format: {fmt}")
    return path


def write_metrics(metrics: DataFrame, path: str) -> str:
    """The metrics row(s) as CSV with a header."""
    return write_table(metrics.coalesce(1), path, "csv")


def write_anomaly_table(report: DataFrame, path: str) -> bool:
    """Entity, anomaly_score, num_anomalous_features, total_features as CSV,
    written only when the report is not empty.  Returns whether it wrote."""
    out = report.select(*REPORT_COLUMNS)
    if out.isEmpty():
        return False
    write_table(out, path, "csv")
    return True


def save_profiles(profiles: DataFrame, global_prof: DataFrame, windows: DataFrame, path: str,
                  fmt: str = "parquet", features: list[str] | None = None) -> str:
    """A10: long entity profiles, per-entity window counts and the population
    profile, side by side under ``path``; with ``features`` also one wide row
    per entity (``<feature>_<statistic>`` columns, num_time_windows)."""
    base = path.rstrip("/")
    write_table(profiles, f"{base}/entity_profiles", fmt)
    if features:
        # made from the written rows, so the profiles are computed once
        wide = wide_profiles(_reader(profiles.sparkSession, fmt)(f"{base}/entity_profiles"), windows, features)
        write_table(wide, f"{base}/wide_profiles", fmt)
    write_table(windows, f"{base}/windows", fmt)
    write_table(global_prof, f"{base}/global_profile", fmt)
    return base


def load_profiles(spark: SparkSession, path: str, fmt: str = "parquet"):
    """(entity_profiles, global_profile, windows) as written by save_profiles."""
    base, load = path.rstrip("/"), _reader(spark, fmt)
    return load(f"{base}/entity_profiles"), load(f"{base}/global_profile"), load(f"{base}/windows")


def load_wide_profiles(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The wide rows that save_profiles wrote for its ``features``."""
    return _reader(spark, fmt)(f"{path.rstrip('/')}/wide_profiles")


def _reader(spark: SparkSession, fmt: str):
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv
    return spark.read.parquet


def result_summary(metrics: DataFrame, digits: int = 4) -> DataFrame:
    """Metric name -> value rounded to ``digits`` places (long form)."""
    names = [c for c in metrics.columns if c != "model"]
    cast = metrics.select(*[F.col(c).cast("double").alias(c) for c in names],
                          *([F.col("model")] if "model" in metrics.columns else []))
    ids = ["model"] if "model" in metrics.columns else []
    long = cast.unpivot(ids, names, "metric", "value")
    return long.withColumn("value", F.round("value", digits))
