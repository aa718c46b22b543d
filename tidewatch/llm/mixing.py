"""Mixing sources to target weights by systematic sampling.

Each source's share of all words follows its weight, up to ``max_repeat``
times its own size; what a capped source cannot take is shared again among
the others by weight.  Every document of a source expects target / size
copies.  The documents of a source are laid out in order of size, the running
sum of expected copies gets one random offset per source, and a document is
emitted once per integer boundary that its stretch crosses.  Laying out by
size spreads the draw over all lengths, so taken words stay close to the
target and no document exceeds ``max_repeat`` copies (rounded up).

The order is global over (source, size, document): a range partitioning, a
position inside each partition and the row counts of the partitions before,
so that a source with a third of all rows is spread over many tasks.

A null source is a source of its own, last in order.  A null or empty text
has size 0 and expects the same number of copies as any other document of
its source.  Ties in size are ordered by document id and a hash of the text;
rows equal in all that draw as rows of their own, in any order.  A source
without words, or an empty table, gives targets of 0 and no copies.  Other
columns are carried through ``emit``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.hashing import hash_unit
from tidewatch.functions.ranking import global_index, prefix_sums
from tidewatch.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """(source, source_size, n_docs, weight, target) from (source, size) rows.

    Weights repeat over the sources in order of code point, null last.  The
    share of the whole is lowered to the cap where it is above, round by round;
    only one row of sums per round reaches the driver."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = global_index(per, [F.col("source").isNull(), F.col("source")], "_nth")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = materialize(per.withColumn("weight", F.get(cycle, (F.col("_nth") % len(weights)).cast("int"))).drop("_nth"), "sources")
    total = per.agg(F.sum("source_size")).head()[0] or 0
    cap = F.col("source_size") * float(max_repeat)
    rate = None  # words per unit of weight among the sources below their cap
    while True:
        capped = F.lit(False) if rate is None else F.col("weight") * rate > cap
        s = per.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).head()
        new = (total - (s[0] or 0.0)) / s[1] if s[1] else 0.0
        if new == rate or not s[1]:
            break
        rate = new
    target = F.least(F.col("weight") * float(rate or 0.0), cap)
    return per.withColumn("target", target)


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: int = 3, seed: int = 42,
        key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: (key, tie, size, source, source_size, target,
    copies); tie is a hash of the text."""
    sizes = materialize(docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("tie"), F.col(source).alias("source"), word_count(text).alias("size")), "sizes")
    per = source_targets(sizes, weights, max_repeat)
    placed = global_index(sizes, [F.col("source").isNull(), F.col("source"), "size", "_key", "tie"], "_at")
    # where each source begins in that order: the documents of the sources before it
    begins = prefix_sums(per.withColumn("_last", F.col("source").isNull()), ["_last", "source"], ["n_docs"])
    begins = begins.withColumn("_first", F.col("cum_n_docs") - F.col("n_docs"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = hash_unit(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), seed)
    begins = begins.select(F.col("source").alias("_source"), "source_size", "target", "_first", expected.alias("_expected"), offset.alias("_offset"))
    rank = F.col("_at") - F.col("_first")
    copies = F.floor((rank + 1) * F.col("_expected") + F.col("_offset")) - F.floor(rank * F.col("_expected") + F.col("_offset"))
    return (placed.join(begins, F.col("source").eqNullSafe(F.col("_source")))
            .select(F.col("_key").alias(key), "tie", "size", "source", "source_size", "target", copies.cast("long").alias("copies")))


def emit(docs: DataFrame, copies: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` repeated as ``copies`` (of ``mix``) says, with the
    columns of ``docs``.  Rows equal in id, source and text take the counts of
    their kind in turn."""
    names = ["_key", "_source", "_tie", "_nth"]
    same = Window.partitionBy(*names[:3])
    times = copies.select(F.col(key).alias("_key"), F.col("source").alias("_source"), F.col("tie").alias("_tie"), F.col("copies").alias("_copies"))
    times = times.withColumn("_nth", F.row_number().over(same.orderBy("_copies"))).where("_copies > 0")
    # the columns of docs travel as one value, so that no name can clash
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("_key"), F.col(source).alias("_source"), F.xxhash64(text).alias("_tie"),
                       F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns if c != text]).alias("_rest"))
    rows = rows.withColumn("_nth", F.row_number().over(same.orderBy("_rest")))
    equal = [rows[n].eqNullSafe(times[n]) for n in names]
    return rows.join(times, equal).select("row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")
