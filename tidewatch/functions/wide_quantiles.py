"""Exact quantiles of all numeric columns in a few wide aggregates.

Columns of few values take one exact ``percentile`` aggregate after they are
counted.  For others, one aggregate over the table gives every column its count, extremes and a KLL
sketch (Spark's mergeable quantile sketch), so the table is neither unpivoted
nor persisted.  The sketch brackets each wanted position; one more aggregate
counts the values below and inside every bracket, which places the position
exactly, and sketches the inside.  A bracket that holds more than
``RANKED_VALUES`` values is narrowed by its own sketch and counted again; one
that misses is opened to the column's extreme on that side and narrowed again.
The last job ranks the distinct values inside the brackets, which are few.

The driver sees one row per aggregate: a few numbers per column and
probability.  NULL and NaN are no values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH_K = 4096              # rank error of one sketch: below 0.1 %
RANK_ERROR = 0.002           # half width of a bracket in ranks
RANKED_VALUES = 1_000_000    # values inside a bracket that are ranked
WHOLE = 100_000              # columns with so many values take Spark's exact percentile
GRID = 200                   # steps in which a wide bracket is narrowed


@dataclass
class ColumnStats:
    """count, min, max, quantiles (as asked) and other aggregates of a column."""
    count: int
    min: float | None
    max: float | None
    quantiles: list[float | None]
    other: dict = field(default_factory=dict)


@dataclass
class _Bracket:
    column: int
    prob: int
    first: int       # 0-based positions of the two neighbours of the quantile
    last: int
    low: float
    high: float
    below: int = 0
    inside: int = 0
    placed: bool = False

    def within(self, x: Column) -> Column:
        return (x >= F.lit(self.low)) & (x <= F.lit(self.high))


def _values(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    out = []
    for c in columns:
        x = F.col("`" + c.replace("`", "``") + "`").cast("double")
        out.append(F.when(~F.isnan(x), x))
    return out


def _sketched(sketch: Column, n: Column, ranks: list[float]) -> Column:
    """Values of a sketch at some ranks; null where it is empty."""
    return F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(min(1.0, max(0.0, r))) for r in ranks])))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], other: dict | None = None) -> dict[str, ColumnStats]:
    """Linearly interpolated quantiles (pandas / quantile_cont definition) of
    ``columns``; ``other`` names further aggregates {name: function of a
    column} that ride on the first pass."""
    columns, probs, other = list(columns), [float(p) for p in probs], other or {}
    if not columns:
        return {}
    x = _values(df, columns)
    aggs = []
    for i in range(len(columns)):
        aggs += [F.count(x[i]).alias(f"n{i}"), F.min(x[i]).alias(f"lo{i}"), F.max(x[i]).alias(f"hi{i}"),
                 F.kll_sketch_agg_double(x[i], F.lit(SKETCH_K)).alias(f"s{i}"), *[fn(x[i]).alias(f"o{i}_{k}") for k, fn in other.items()]]
    row = df.agg(*aggs)
    ranks = [p + sign * RANK_ERROR for p in probs for sign in (-1, 1)]
    ends = [_sketched(F.col(f"s{i}"), F.col(f"n{i}"), ranks).alias(f"b{i}") for i in range(len(columns))]
    keep = [F.col(c) for c in row.columns if not (c[0] == "s" and c[1:].isdigit())]
    row = row.select(*keep, *ends).head()
    out, brackets = {}, []
    for i, c in enumerate(columns):
        n, low, high = row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]
        out[c] = ColumnStats(n, low, high, [None] * len(probs), {k: row[f"o{i}_{k}"] for k in other})
        for j, p in enumerate(probs if n > WHOLE else []):
            at = math.floor((n - 1) * p)
            a, b = row[f"b{i}"][2 * j:2 * j + 2]
            a, b = (low if p <= RANK_ERROR else a), (high if p + RANK_ERROR >= 1 else b)
            brackets.append(_Bracket(i, j, at, min(at + 1, n - 1), a, b))
    small = [i for i, c in enumerate(columns) if 0 < out[c].count <= WHOLE]
    if small:
        asked = F.array(*[F.lit(p) for p in probs])
        row = df.agg(*[F.percentile(x[i], asked).alias(f"q{i}") for i in small]).head()
        for i in small:
            out[columns[i]].quantiles = list(row[f"q{i}"])
    _place(df, x, [out[c] for c in columns], brackets)
    found = _ranked(df, x, brackets)
    for b in brackets:
        stats = out[columns[b.column]]
        v0, v1 = (found[b.column, b.prob, at] for at in (b.first, b.last))
        part = (stats.count - 1) * probs[b.prob] - b.first
        stats.quantiles[b.prob] = v0 if v0 == v1 else v0 + part * (v1 - v0)
    return out


def _place(df: DataFrame, x: list[Column], stats: list[ColumnStats], brackets: list[_Bracket]) -> None:
    """Count below and inside the brackets until each holds its positions and
    few enough values (or copies of one value)."""
    while todo := [b for b in brackets if not b.placed]:
        aggs = []
        for k, b in enumerate(todo):
            v = x[b.column]
            aggs += [F.count_if(v < F.lit(b.low)).alias(f"n{k}"), F.count_if(b.within(v)).alias(f"m{k}")]
            if stats[b.column].count > RANKED_VALUES:
                aggs.append(F.kll_sketch_agg_double(F.when(b.within(v), v), F.lit(SKETCH_K)).alias(f"s{k}"))
        row, ends = df.agg(*aggs), []
        for k, b in enumerate(todo):
            if f"s{k}" in row.columns:
                ends.append(_sketched(F.col(f"s{k}"), F.col(f"m{k}"), [r / GRID for r in range(GRID + 1)]).alias(f"b{k}"))
        row = row.select(*[F.col(c) for c in row.columns if c[0] != "s"], *ends).head()
        for k, b in enumerate(todo):
            b.below, b.inside = row[f"n{k}"], row[f"m{k}"]
            if b.below > b.first or b.last >= b.below + b.inside:  # missed: open that side
                b.low = stats[b.column].min if b.below > b.first else b.low
                b.high = stats[b.column].max if b.last >= b.below + b.inside else b.high
            elif b.inside <= RANKED_VALUES or b.low == b.high:
                b.placed = True
            else:
                grid = [b.low, *row[f"b{k}"], b.high]  # one step of the grid is more than the sketch's error
                low = grid[max(0, (b.first - b.below) * GRID // b.inside)]
                high = grid[min(GRID + 2, (b.last - b.below) * GRID // b.inside + 3)]
                b.placed = (low, high) == (b.low, b.high)  # as narrow as it gets: few distinct values
                b.low, b.high = low, high


def _ranked(df: DataFrame, x: list[Column], brackets: list[_Bracket]) -> dict[tuple[int, int, int], float]:
    """{(column, prob, position): value} from the values inside the brackets."""
    found = {}
    for b in brackets:
        if b.low == b.high:
            found[b.column, b.prob, b.first] = found[b.column, b.prob, b.last] = b.low
    todo = [b for b in brackets if b.low < b.high]
    if not todo:
        return found
    hits = [F.when(b.within(x[b.column]), F.struct(F.lit(k).alias("k"), x[b.column].alias("v"))) for k, b in enumerate(todo)]
    rows = df.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).groupBy("h.k", "h.v").agg(F.count(F.lit(1)).alias("c"))
    # a bracket's distinct values are at most RANKED_VALUES, so one task ranks them
    upto = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum("c").over(upto))
    wanted = F.lit(False)
    for k, b in enumerate(todo):
        for at in {b.first - b.below, b.last - b.below}:
            wanted = wanted | ((F.col("k") == k) & (F.col("end") > at) & (F.col("end") - F.col("c") <= at))
    for r in rows.where(wanted).collect():  # two values a bracket at most
        b = todo[r.k]
        for at in (b.first, b.last):
            if r.end - r.c <= at - b.below < r.end:
                found[b.column, b.prob, at] = r.v
    return found
