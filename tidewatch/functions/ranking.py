"""Global order without a single-partition window.

``orderBy`` + ``row_number() over (order by ...)`` moves every row into one
task.  Here rows are range-partitioned and sorted inside each partition, the
partition layout is pinned by writing the table (so recomputing a
lost partition cannot change the layout), and each row's global position is
its position inside its partition plus the row count of the partitions before
it (a table with one row per partition, broadcast).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import ensure_checkpoint_dir, materialize

_LOCAL_BITS = 33  # monotonically_increasing_id = partition id << 33 | row in partition


ROWS_PER_PARTITION = 4_000_000  # bound of one range partition (one task sorts and windows it)


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    """Range partitions: at least the shuffle setting, and enough that no
    partition holds more than ROWS_PER_PARTITION rows (one count job)."""
    if num_partitions:
        return num_partitions
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    n = df.count()
    return max(base, -(-n // ROWS_PER_PARTITION))


def ranged(df: DataFrame, order_cols, num_partitions: int | None = None) -> DataFrame:
    """Range-partitioned, sorted, checkpointed copy with ``_pid`` and ``_local``."""
    ensure_checkpoint_dir(df.sparkSession)
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    out = df.repartitionByRange(_partitions(df, num_partitions), *cols).sortWithinPartitions(*cols)
    # written once: the ids (partition, position) are stored as data
    out = materialize(out.withColumn("_mid", F.monotonically_increasing_id()), "ranged")
    return out.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS)) \
              .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))) \
              .drop("_mid")


def _offsets(r: DataFrame, weight: str | None = None) -> DataFrame:
    agg = F.count(F.lit(1)) if weight is None else F.sum(weight)
    per = r.groupBy("_pid").agg(agg.alias("_cnt"))
    # one row per partition: a window over all of it is tiny
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0))).drop("_cnt")


def global_index(df: DataFrame, order_cols, out: str = "idx",
                 num_partitions: int | None = None) -> DataFrame:
    """0-based contiguous position of each row in ``order_cols`` order."""
    r = ranged(df, order_cols, num_partitions)
    offs = _offsets(r)
    return r.join(F.broadcast(offs), "_pid").withColumn(out, F.col("_off") + F.col("_local")) \
            .drop("_pid", "_local", "_off")


def prefix_sums(df: DataFrame, order_cols, sum_cols, num_partitions: int | None = None,
                descending: bool = False) -> DataFrame:
    """Running totals of ``sum_cols`` in ``order_cols`` order (inclusive),
    named ``cum_<col>``.  ``descending`` sorts the order columns descending."""
    cols = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    r = ranged(df, cols, num_partitions)
    w = Window.partitionBy("_pid").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    out = r
    per = r.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    wo = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}")
                                for c in sum_cols])
    for c in sum_cols:
        out = out.withColumn(f"_l_{c}", F.sum(c).over(w))
    out = out.join(F.broadcast(offs), "_pid")
    for c in sum_cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.col(f"_l_{c}")).drop(f"_o_{c}", f"_l_{c}")
    return out.drop("_pid", "_local")
