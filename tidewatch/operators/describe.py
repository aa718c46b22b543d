"""Table descriptions: NULL counts, value counts, summary statistics, dataset
summary (C1, F8, F9, A14).  Each is one aggregation pass; quantiles take a few
wide aggregates over all columns, so no column is gathered into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import without_nan
from tidewatch.functions.wide_quantiles import column_quantiles
from tidewatch.operators.schema import column_roles, q


def null_counts(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """Missing values (NULL or NaN) per column in one pass; by default only
    columns with any."""
    df = without_nan(df)
    aggs = [F.count_if(F.col(q(c)).isNull()).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    long = wide.unpivot([], df.columns, "column", "n_missing")
    return long.where(F.col("n_missing") > 0) if only_missing else long


def value_counts(df: DataFrame, column: str, out: str = "count") -> DataFrame:
    """F8: rows per value, most frequent first."""
    return df.groupBy(F.col(q(column)).alias("value")).agg(F.count(F.lit(1)).alias(out)) \
        .orderBy(F.col(out).desc(), F.col("value").asc_nulls_first())


def summary(df: DataFrame, columns=None) -> DataFrame:
    """count, mean, std, min, q1, median, q3, max per numeric column (exact
    quantiles), one row per column."""
    if columns is None:
        columns, _ = column_roles(df)
    cols = list(columns)
    stats = column_quantiles(df, cols, [0.25, 0.5, 0.75], {"mean": F.avg, "std": F.stddev_samp})
    rows = [(c, s.count, s.other["mean"], s.other["std"], s.min, *s.quantiles, s.max) for c, s in stats.items() if s.count]
    return df.sparkSession.createDataFrame(rows, "column string, count long, mean double, std double, min double, "
                                                 "q1 double, median double, q3 double, max double")


def dataset_summary(df: DataFrame, target: str) -> DataFrame:
    """Rows, columns and the class distribution (one row per class)."""
    n_cols = len(df.columns)
    per_class = df.groupBy(F.col(q(target)).alias("class")).agg(F.count(F.lit(1)).alias("class_count"))
    # the per-class table has one row per class, so a window over all of it is tiny
    from pyspark.sql import Window
    n_rows = F.sum("class_count").over(Window.partitionBy())
    return per_class.select(n_rows.alias("n_rows"), F.lit(n_cols).alias("n_columns"),
                            "class", "class_count")
