"""Exact order statistics per group without gathering a large group into one task.

A plain ``percentile`` or ``row_number() over (partition by g order by v)``
puts every value of a group into one task.  That is only done here for
groups whose size is bounded (``_SMALL * accuracy`` rows).  For larger groups
each requested position is first bracketed with ``percentile_approx`` (a
mergeable sketch: partial aggregation, bounded memory), then only the rows
inside the bracket are ranked, on top of one pre-aggregated count of the rows
below it.  The bracket holds about ``6 n / accuracy`` rows; brackets above
BRACKET_ROWS are narrowed by value-histogram rounds (each ~BUCKETS-fold), so
one task ranks a bounded slice of even a hot group at any scale.  A group
whose bracket misses its position (not expected: the sketch's rank error is
below the margin) is recomputed exactly by ranking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tidewatch.session import materialize

_MARGIN = 3.0  # bracket half-width in units of the sketch's rank error
# groups up to _SMALL * accuracy rows are solved whole (bounded work per task);
# above it the bracket is at least 3 * _SMALL ranks wide on each side
_SMALL = 5


def _stats_table(base: DataFrame, g: list[str], probs: list[float], pos_fn, accuracy: int) -> DataFrame:
    """One row per group: n, the bracket (lo, hi) of each probability and the
    wanted 0-based positions."""
    eps = _MARGIN / accuracy
    pcts = []
    for p in probs:
        pcts += [max(0.0, p - eps), min(1.0, p + eps)]
    stats = base.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"),
                                 F.percentile_approx("_o", pcts, accuracy).alias("_ap"))
    cols = [F.col(c) for c in g] + [F.col("_n")]
    for i in range(len(probs)):
        cols.append(F.col("_ap")[2 * i].alias(f"_lo{i}"))
        cols.append(F.col("_ap")[2 * i + 1].alias(f"_hi{i}"))
        for j, pos in enumerate(pos_fn(F.col("_n"), probs[i])):
            cols.append(pos.cast("long").alias(f"_p{i}_{j}"))
    return stats.select(*cols)


def _wanted(table: DataFrame, g: list[str], n_probs: int, n_pos: int) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j"), F.col(f"_p{i}_{j}").alias("_pos"))
            for i in range(n_probs) for j in range(n_pos)]
    return table.select(*g, "_n", F.explode(F.array(*rows)).alias("w")).select(*g, "_n", "w.*")


def _rank_whole(base: DataFrame, wanted: DataFrame, g: list[str], ties: list[str]) -> DataFrame:
    """Exact positions by ranking whole groups (only for bounded groups)."""
    wr = Window.partitionBy(*g).orderBy(F.col("_o").asc(), *[F.col(t).asc() for t in ties])
    ranked = base.join(wanted.select(*g).distinct(), g, "left_semi") \
        .withColumn("_pos", F.row_number().over(wr) - 1)
    return ranked.join(wanted, [*g, "_pos"]).select(*g, "_i", "_j", "_pos", "_n", "_o", *ties)


BRACKET_ROWS = 2_000_000  # largest bracket ranked directly; larger ones are refined first
BUCKETS = 1024            # value buckets per refinement round


def _refine(base: DataFrame, bounds: DataFrame, g: list[str], few_groups: bool) -> DataFrame:
    """Narrow brackets holding more than BRACKET_ROWS rows.

    ``bounds``: one row per (group, i) with lo, hi, below (rows under lo) and
    the wanted positions p0 <= p1.  Each round histograms the rows of a wide
    bracket into BUCKETS equal-width value buckets (one aggregate, per-bucket
    count / min / max), keeps the buckets holding p0..p1 and sets the new
    bracket to their min..max, so a round shrinks a bracket ~BUCKETS-fold
    unless the rows are copies of one value (which ranking collapses anyway).
    """
    spark = base.sparkSession
    for _ in range(8):
        # a bracket narrowed to one value needs no more rounds: its copies collapse when counted
        wide = bounds.where((F.col("_inside") > F.lit(BRACKET_ROWS)) & (F.col("_hi") > F.col("_lo")))
        if wide.isEmpty():
            break
        side = F.broadcast(wide) if few_groups else wide
        rows = base.join(side, g).where((F.col("_o") >= F.col("_lo")) & (F.col("_o") <= F.col("_hi")))
        width = (F.col("_hi") - F.col("_lo")) / F.lit(float(BUCKETS))
        bucket = F.when(width <= 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col("_o") - F.col("_lo")) / width).cast("int"), F.lit(BUCKETS - 1)))
        hist = rows.groupBy(*g, "_i", bucket.alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_o").alias("_bmin"), F.max("_o").alias("_bmax"))
        # at most BUCKETS rows per (group, i): a window over them is small
        w = Window.partitionBy(*g, "_i").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.join(wide.select(*g, "_i", "_below", "_p0", "_p1"), [*g, "_i"]) \
            .withColumn("_cum", F.sum("_c").over(w) + F.col("_below"))
        hist = hist.withColumn("_first", F.col("_cum") - F.col("_c"))
        keep = hist.where((F.col("_cum") > F.col("_p0")) & (F.col("_first") <= F.col("_p1")))
        new = keep.groupBy(*g, "_i").agg(
            F.min("_bmin").alias("_lo"), F.max("_bmax").alias("_hi"), F.min("_first").alias("_below"),
            F.sum("_c").alias("_inside"))
        narrowed = bounds.join(new.select(*g, "_i"), [*g, "_i"], "left_anti").unionByName(
            bounds.drop("_lo", "_hi", "_below", "_inside").join(new, [*g, "_i"]))
        bounds = materialize(narrowed, "brackets")
    return bounds


def _bracketed(base: DataFrame, table: DataFrame, g: list[str], ties: list[str], n_probs: int,
               n_pos: int, few_groups: bool, retry: bool = True) -> DataFrame:
    """Positions of large groups: rank only the rows inside each bracket.

    Passes over the (persisted) input: an aggregate counting the rows below
    and inside each bracket, refinement rounds for brackets that are still
    wide, and a filter keeping the rows inside a bracket, which alone are
    ranked (copies of one value collapse into one counted row)."""
    wanted = _wanted(table, g, n_probs, n_pos)
    pos = wanted.groupBy(*g, "_i").agg(F.min("_pos").alias("_p0"), F.max("_pos").alias("_p1"))
    lohi = table.select(*g, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.col(f"_lo{i}").alias("_lo"), F.col(f"_hi{i}").alias("_hi"))
        for i in range(n_probs)])).alias("b")).select(*g, "b.*")
    side = F.broadcast(lohi) if few_groups else lohi
    counts = base.join(side, g).groupBy(*g, "_i").agg(
        F.count_if(F.col("_o") < F.col("_lo")).alias("_below"),
        F.count_if((F.col("_o") >= F.col("_lo")) & (F.col("_o") <= F.col("_hi"))).alias("_inside"))
    bounds = materialize(lohi.join(counts, [*g, "_i"]).join(pos, [*g, "_i"]), "brackets")
    bounds = _refine(base, bounds, g, few_groups)
    bside = F.broadcast(bounds) if few_groups else bounds
    rows = base.join(bside, g).where((F.col("_o") >= F.col("_lo")) & (F.col("_o") <= F.col("_hi")))
    counted = rows.groupBy(*g, "_i", "_below", "_o", *ties).agg(F.count(F.lit(1)).alias("_c"))
    w = (Window.partitionBy(*g, "_i").orderBy(F.col("_o").asc(), *[F.col(t).asc() for t in ties])
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("_cum", F.sum("_c").over(w) + F.col("_below"))
    ranked = ranked.withColumn("_first", F.col("_cum") - F.col("_c"))
    hit = ranked.join(F.broadcast(wanted) if few_groups else wanted, [*g, "_i"]).where(
        (F.col("_pos") >= F.col("_first")) & (F.col("_pos") < F.col("_cum")))
    found = hit.select(*g, "_i", "_j", "_pos", "_n", "_o", *ties).persist(StorageLevel.MEMORY_AND_DISK)
    missing = wanted.join(found.select(*g, "_i", "_j"), [*g, "_i", "_j"], "left_anti")
    if not missing.isEmpty():
        bad = missing.select(*g).distinct()
        if retry:
            # the group's full range always holds its positions; refinement keeps it bounded
            mm = base.join(bad, g, "left_semi").groupBy(*g).agg(F.min("_o").alias("_mn"), F.max("_o").alias("_mx"))
            t2 = table.join(mm, g)
            for i in range(n_probs):
                t2 = t2.withColumn(f"_lo{i}", F.col("_mn")).withColumn(f"_hi{i}", F.col("_mx"))
            redo = _bracketed(base, t2.drop("_mn", "_mx"), g, ties, n_probs, n_pos, few_groups, retry=False)
        else:
            redo = _rank_whole(base, wanted.join(bad, g, "left_semi"), g, ties)
        found = found.join(bad, g, "left_anti").unionByName(redo)
    return found


def group_quantiles(df: DataFrame, group_cols, value_col: str, probs, *,
                    accuracy: int = 10000, few_groups: bool = False) -> DataFrame:
    """Linearly interpolated quantiles (pandas / quantile_cont definition).

    Returns ``group_cols + [p, value]``; NULL values are ignored, a group with
    no value gives no row.  The (small) result is checkpointed.
    """
    g = list(group_cols)
    probs = [float(p) for p in probs]
    base = df.select(*[F.col(c) for c in g], F.col(value_col).cast("double").alias("_o"))
    base = base.where(F.col("_o").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)

    def pos_fn(n, p):
        r = (n - 1).cast("double") * F.lit(p)
        p0 = F.floor(r)
        return [p0, F.least(p0 + 1, n - 1)]

    limit = F.lit(_SMALL * accuracy)
    p_arr = F.array(*[F.lit(p) for p in probs])
    # group sizes first (a plain count): the sketch is only built for large groups
    sizes = base.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")).persist(StorageLevel.MEMORY_AND_DISK)
    # bounded groups: the exact percentile aggregate (partial aggregation of value counts)
    small_keys = sizes.where(F.col("_n") <= limit).select(*g)
    small = base.join(F.broadcast(small_keys) if few_groups else small_keys, g, "left_semi") \
        .groupBy(*g).agg(F.percentile("_o", p_arr).alias("_q"))
    parts = [small.select(*g, F.posexplode("_q").alias("_i", "value"))
             .select(*g, p_arr[F.col("_i")].alias("p"), "value")]
    found = table = None
    large_keys = sizes.where(F.col("_n") > limit).select(*g)
    if not large_keys.isEmpty():
        lbase = base.join(F.broadcast(large_keys) if few_groups else large_keys, g, "left_semi")
        table = _stats_table(lbase, g, probs, pos_fn, accuracy).persist(StorageLevel.MEMORY_AND_DISK)
        found = _bracketed(lbase, table, g, [], len(probs), 2, few_groups)
        rank = (F.col("_n") - 1).cast("double") * p_arr[F.col("_i")]
        frac = rank - F.floor(rank)
        lq = found.groupBy(*g, "_i").agg(
            F.max(F.when(F.col("_j") == 0, F.col("_o"))).alias("_v0"),
            F.max(F.when(F.col("_j") == 1, F.col("_o"))).alias("_v1"),
            F.max("_n").alias("_n"))
        parts.append(lq.select(*g, p_arr[F.col("_i")].alias("p"),
                               (F.col("_v0") + frac * (F.col("_v1") - F.col("_v0"))).alias("value")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    result = materialize(out, "quantiles")
    for d in (found, table, sizes, base):
        if d is not None:
            d.unpersist()
    return result


def rank_cuts(df: DataFrame, group_cols, order_col: str, tie_cols, fractions, *,
              accuracy: int = 10000, few_groups: bool = True) -> DataFrame:
    """Per group and fraction f, the row at 1-based rank ``floor(f * n)`` in
    (order, ties) order.  Returns ``group_cols + [f, _n, cut_o, <ties>]``;
    a fraction whose rank is 0 yields a NULL cut (nothing at or below).
    The (small) result is checkpointed."""
    g = list(group_cols)
    ties = list(tie_cols)
    fractions = [float(f) for f in fractions]
    base = df.select(*[F.col(c) for c in g], F.col(order_col).alias("_o"), *[F.col(t) for t in ties])
    base = base.persist(StorageLevel.MEMORY_AND_DISK)

    def pos_fn(n, f):
        return [F.greatest(F.floor(n.cast("double") * F.lit(f)) - 1, F.lit(0))]

    table = _stats_table(base, g, fractions, pos_fn, accuracy).persist(StorageLevel.MEMORY_AND_DISK)
    limit = F.lit(_SMALL * accuracy)
    small_t = table.where(F.col("_n") <= limit)
    parts = [_rank_whole(base, _wanted(small_t, g, len(fractions), 1), g, ties)]
    large = table.where(F.col("_n") > limit)
    found = None
    if not large.isEmpty():
        found = _bracketed(base, large, g, ties, len(fractions), 1, few_groups)
        parts.append(found)
    hits = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    f_arr = F.array(*[F.lit(f) for f in fractions])
    keyed = table.select(*g, "_n", F.explode(F.sequence(F.lit(0), F.lit(len(fractions) - 1))).alias("_i"))
    out = keyed.join(hits.drop("_j", "_pos", "_n"), [*g, "_i"], "left")
    empty = F.floor(F.col("_n").cast("double") * f_arr[F.col("_i")]) < 1
    cols = [*[F.col(c) for c in g], f_arr[F.col("_i")].alias("f"), F.col("_n"),
            F.when(empty, F.lit(None)).otherwise(F.col("_o")).alias("cut_o")]
    cols += [F.when(empty, F.lit(None)).otherwise(F.col(t)).alias(t) for t in ties]
    result = materialize(out.select(*cols), "rank-cuts")
    for d in (found, table, base):
        if d is not None:
            d.unpersist()
    return result
