"""Sampling, splitting and class balance.

Every random choice is a hash of (seed, key), so results do not depend on
partitioning or retries.  Exact-size selections ("the n rows with the
smallest hash") never rank a whole table or class in one task: the cut row is
found by ``hash_cuts`` (hashes of distinct keys are uniform, so the k-th of n
lies within a few sigma of k / n; one pass counts below and ranks the few rows
in between) and the rows are kept with a filter against a one-row-per-class
cut table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.hashing import DEFAULT_SEED, hash_int, hash_unit
from tidewatch.functions.order_stats import rank_cuts
from tidewatch.operators.schema import q
from tidewatch.session import materialize

MAX_CLASSES = 10_000  # a label with more values is refused: its classes are listed on the driver


def _with_hash(df: DataFrame, key: str, seed: int, out: str = "_h") -> DataFrame:
    return df.withColumn(out, hash_int(F.col(q(key)), seed))


HASHES = float(16 ** 15)  # values of a hash
SIGMAS = 8.0              # half width of the bracket of a cut


def hash_cuts(df: DataFrame, group_cols, hash_col: str, tie: str, fractions) -> DataFrame:
    """Per group and fraction f, the row at 1-based rank ``floor(f * n)`` in
    (hash, tie) order: group_cols + [f, _n, cut_o, tie], null where the rank is
    0.  Rows without a group have no cut.

    The bracket of a cut holds about 16 sqrt(n) rows.  Where it misses (keys
    that repeat share a hash, so hashes need not be uniform), the cuts are
    found by ``rank_cuts``."""
    g, fractions = list(group_cols), [float(f) for f in fractions]
    n = df.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
    cut = n.select(*g, "_n", F.posexplode(F.array(*[F.lit(f) for f in fractions])).alias("_i", "f"))
    cut = cut.withColumn("_k", F.floor(F.col("_n").cast("double") * F.col("f")))
    share = F.col("_k") / F.col("_n")
    width = F.lit(SIGMAS) * (F.sqrt(share * (1 - share) / F.col("_n")) + 2 / F.col("_n"))
    cut = materialize(cut.withColumn("_lo", (share - width) * HASHES).withColumn("_hi", (share + width) * HASHES), "brackets")
    rows = df.select(*g, F.col(hash_col).alias("_o"), F.col(tie).alias("_t")).join(cut.where("_k > 0"), g).where(F.col("_o") <= F.col("_hi"))
    low = F.col("_o") < F.col("_lo")  # rows below a bracket become one counted row per task
    rows = rows.groupBy(*g, "_i", "_k", F.when(~low, F.col("_o")).alias("_o"), F.when(~low, F.col("_t")).alias("_t")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*g, "_i").orderBy(F.col("_o").asc_nulls_first(), F.col("_t").asc_nulls_first())
    rows = rows.withColumn("_end", F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hits = rows.where((F.col("_end") >= F.col("_k")) & (F.col("_end") - F.col("_c") < F.col("_k")) & F.col("_o").isNotNull())
    found = materialize(cut.join(hits.select(*g, "_i", "_o", "_t"), [*g, "_i"], "left"), "cuts")
    known = F.lit(True)
    for c in g:
        known = known & F.col(c).isNotNull()
    if not found.where((F.col("_k") > 0) & F.col("_o").isNull() & known).isEmpty():
        return rank_cuts(df, g, hash_col, [tie], fractions, few_groups=True)
    return found.select(*g, "f", "_n", F.col("_o").alias("cut_o"), F.col("_t").alias(tie))


def _keep_upto(df: DataFrame, group_cols, key: str, fraction: float, seed: int) -> DataFrame:
    """Rows whose (hash, key) is at or below the cut of their group."""
    g = list(group_cols)
    h = _with_hash(df, key, seed)
    if not g:
        h = h.withColumn("_g", F.lit(0))
        g = ["_g"]
    cuts = hash_cuts(h, g, "_h", key, [fraction])
    cuts = cuts.select(*g, F.col("cut_o").alias("_cut_h"), F.col(key).alias("_cut_k"))
    j = h.join(F.broadcast(cuts), g)
    keep = (F.col("_h") < F.col("_cut_h")) | ((F.col("_h") == F.col("_cut_h")) & (F.col(q(key)) <= F.col("_cut_k")))
    out = j.where(keep).drop("_h", "_cut_h", "_cut_k")
    return out.drop("_g") if "_g" in out.columns else out


def sample_n(df: DataFrame, n: int, key: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """Exactly ``n`` rows (the n smallest hashes) when the table is larger."""
    total = df.count()
    if n >= total:
        return df
    if n <= 0:
        return df.limit(0)
    # fraction chosen so that floor(f * total) == n
    f = (n + 0.5) / total
    return _keep_upto(df, [], key, f, seed)


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """Bernoulli sample by hash (repeatable, one pass, no shuffle)."""
    return df.where(hash_unit(F.col(q(key)), seed) < F.lit(float(fraction)))


def sample_ratio(df: DataFrame, ratio: float, key: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """Exactly floor(count * ratio) rows."""
    total = df.count()
    return sample_n(df, int(math.floor(total * ratio)), key, seed)


def sample_size(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Sample size min(rows, cap) and ratio = size / rows; without a cap all
    rows (Spark spills, so no memory term)."""
    c = df.agg(F.count(F.lit(1)).alias("row_count"))
    size = F.col("row_count") if cap is None else F.least(F.col("row_count"), F.lit(cap))
    return c.select("row_count", size.alias("sample_size"),
                    (size / F.col("row_count")).alias("sample_ratio"))


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, val: float = 0.2,
                     seed: int = DEFAULT_SEED, out: str = "split") -> DataFrame:
    """E5: per class, rank by hash; rank <= floor(test*n) -> test,
    <= floor((test+val)*n) -> val, rest -> train."""
    h = _with_hash(df, key, seed)
    cuts = hash_cuts(h, [label], "_h", key, [test, test + val])
    wide = cuts.groupBy(label).agg(
        F.max(F.when(F.col("f") == test, F.struct(F.col("cut_o").alias("h"), F.col(key).alias("k")))).alias("_c1"),
        F.max(F.when(F.col("f") == test + val, F.struct(F.col("cut_o").alias("h"), F.col(key).alias("k")))).alias("_c2"))
    cuts_of = wide.withColumnRenamed(label, "_class")
    j = h.join(cuts_of, F.col(q(label)).eqNullSafe(F.col("_class")), "left").drop("_class")
    me = F.struct(F.col("_h").alias("h"), F.col(q(key)).alias("k"))
    split = (F.when(F.col("_c1.h").isNotNull() & (me <= F.col("_c1")), "test")
             .when(F.col("_c2.h").isNotNull() & (me <= F.col("_c2")), "val")
             .otherwise("train"))
    return j.withColumn(out, split).drop("_h", "_c1", "_c2")


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class; rows without a label are no class (one row per class
    reaches the driver, MAX_CLASSES at most)."""
    rows = df.where(F.col(q(label)).isNotNull()).groupBy(q(label)).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values and is no class label")
    return {r[0]: r[1] for r in rows}


def undersample(df: DataFrame, label: str, key: str, ratio: float = 0.5,
                seed: int = DEFAULT_SEED) -> DataFrame:
    """Keep the minority and rows without a label; keep int(n_min / ratio)
    majority rows (smallest hashes)."""
    counts = class_counts(df, label)
    if len(counts) < 2:
        return df
    minority = min(counts, key=lambda k: (counts[k], k))
    majority = max(counts, key=lambda k: (counts[k], -k if isinstance(k, (int, float)) else 0))
    target = int(counts[minority] / ratio)
    if target >= counts[majority]:
        return df
    maj = df.where(F.col(q(label)) == F.lit(majority))
    kept = sample_n(maj, target, key, seed)
    rest = df.where(~F.col(q(label)).eqNullSafe(F.lit(majority)))
    return rest.unionByName(kept)
