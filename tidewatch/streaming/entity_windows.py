"""Entity-window features (F1/F3) and their scoring against a stored
population profile, over a Structured Streaming source.

The operator is the batch one with a different source: flows arrive through
``readStream``; ``withWatermark`` bounds the state kept per (entity, window)
and late rows beyond it are dropped by the engine; windows are emitted once
complete (``append``).  Exact distinct counts are not available in streaming
aggregation, so ``approx_count_distinct`` (HyperLogLog) replaces them.  Each
finished micro-batch of windows can be scored with ``foreachBatch`` against
a population profile saved by the batch job (A10), so no state grows with
the number of entities beyond open windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.derive import COUNT_COLUMNS, FLOW_COLUMNS, FLOW_STATS
from tidewatch.operators.schema import q


def read_flow_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def stream_entity_window_features(stream: DataFrame, entity_col: str = "Source IP",
                                  time_col: str = "Timestamp", window_seconds: int = 300,
                                  watermark: str = "10 minutes") -> DataFrame:
    """Streaming F3: one row per (entity, window) once the watermark passes."""
    aggs = []
    for c in COUNT_COLUMNS:
        if c in stream.columns:
            aggs += [F.approx_count_distinct(q(c)).alias(f"{c}_nunique"), F.count(q(c)).alias(f"{c}_count")]
    for c in FLOW_COLUMNS:
        if c in stream.columns:
            col = F.col(q(c)).cast("double")
            fns = {"mean": F.avg(col), "std": F.stddev_samp(col), "min": F.min(col), "max": F.max(col),
                   "sum": F.sum(col)}
            aggs += [fns[s].alias(f"{c}_{s}") for s in FLOW_STATS]
    if not aggs:
        raise ValueError("the flow table has none of the columns that window features are made from")
    ts = F.col(q(time_col)).cast("timestamp")
    s = stream.where(F.col(q(entity_col)).isNotNull() & F.col(q(time_col)).isNotNull()) \
        .withColumn("_ts", ts).withWatermark("_ts", watermark)
    g = s.groupBy(F.col(q(entity_col)), F.window("_ts", f"{int(window_seconds)} seconds").alias("_w"))
    return g.agg(*aggs).withColumn("time_window", F.col("_w.start")).drop("_w")


def score_batch(features: DataFrame, entity_col: str, global_profile: DataFrame,
                threshold: float = 2.0, min_std: float = 1e-10) -> DataFrame:
    """Per finished (entity, window): mean z of its features against the
    stored population profile and the number above the threshold."""
    cols = [c for c in features.columns if c not in (entity_col, "time_window")]
    long = features.select(F.col(q(entity_col)).alias("entity"), "time_window",
                           *[F.col(q(c)).cast("double").alias(c) for c in cols]) \
        .unpivot(["entity", "time_window"], cols, "feature", "value").where(F.col("value").isNotNull())
    g = global_profile.select("feature", F.col("mean").alias("g_mean"), F.col("std").alias("g_std")) \
        .where(F.col("g_std") >= min_std)
    z = long.join(F.broadcast(g), "feature").withColumn(
        "z", F.abs((F.col("value") - F.col("g_mean")) / F.col("g_std")))
    return z.groupBy("entity", "time_window").agg(
        F.avg("z").alias("anomaly_score"),
        F.count_if(F.col("z") > F.lit(threshold)).cast("int").alias("num_anomalous_features"),
        F.count(F.lit(1)).cast("int").alias("total_features"))


def start_scoring(features: DataFrame, entity_col: str, global_profile: DataFrame, sink_path: str,
                  checkpoint_path: str, threshold: float = 2.0, trigger_once: bool = False):
    """Write scored windows to Parquet; the checkpoint makes the query restartable."""
    def write(batch: DataFrame, _epoch: int) -> None:
        score_batch(batch, entity_col, global_profile, threshold).write.mode("append").parquet(sink_path)

    w = features.writeStream.outputMode("append").option("checkpointLocation", checkpoint_path) \
        .foreachBatch(write)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
