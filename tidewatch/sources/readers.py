"""Scans (A1-A7): parquet and CSV readers, pruned scans, previews, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when the input arrives in fewer partitions
    than the cluster can run at once (a small table stored as one row group
    would otherwise run every downstream step of its stage in a single task).
    A large table read from many files is left as is: no extra shuffle."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # not spread by default: measured slower on the single-row-group test tables
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _exists(spark: SparkSession, path: str) -> bool:
    # by the file system that Spark itself resolves the path with
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def load_flows(spark: SparkSession, path: str, schema: T.StructType | None = None,
               columns: list[str] | None = None) -> DataFrame:
    """A1/A2/A3/A5: read a flow table by suffix, optionally pruned to ``columns``.

    CSV is read with a header and an explicit schema when given (schema
    inference costs a full extra pass; it is the fallback only).
    """
    if not _exists(spark, path):
        raise FileNotFoundError(f"nothing to read at {path}")
    p = path.rstrip("/")
    if p.endswith(".csv"):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        df = reader.csv(path)
    elif p.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"{path} is neither Parquet nor CSV")
    if columns:
        df = df.select(*[f"`{c}`" for c in columns if c in df.columns])
    return df


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First rows of a table (the column list is ``df.columns``)."""
    return df.limit(n)


def row_count(df: DataFrame) -> DataFrame:
    """Exact row count as a one-row table."""
    from pyspark.sql import functions as F
    return df.agg(F.count(F.lit(1)).alias("n_rows"))
