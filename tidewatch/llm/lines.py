"""Line dedup: repeated line runs by a suffix array, later copies deleted.

Texts are cut at ``\\n``.  Lines found once in the corpus can be in no
repeated run; they end a *segment* of lines that are found again.  Over all
segments a suffix array is built by prefix doubling: the rank of a suffix is
the left bound of the interval of suffixes that agree with it in the first
2**k lines (or to the end of both segments), and a round refines the
intervals of more than one suffix by the rank 2**k lines further on.  Ranks
come from distributed prefix sums over (rank, next rank) pairs.  A round
keeps its interval of every suffix, so the longest-common-prefix interval of
any run of L lines is named by the two overlapping blocks of 2**k <= L lines
at its two ends.

A run of lines counts if it has ``min_words`` words.  Every such run consists
of windows just long enough, counted from each line forwards and from each
line backwards; a window whose interval has an earlier member (by document
id and line) is a later copy, and the lines under it are deleted.  Runs of
deleted lines are thus the maximal repeated runs, and first copies stay.

Words are runs other than ``\\x20`` and ``\\x09``-``\\x0D``.  Null and empty
texts have no lines to delete and stay as they are; a null id comes before
all others.  Rows with one id follow each other by a hash of the text; rows
with one id and text are one document and are cut alike.  An empty table
gives an empty table.  Extra columns are carried through ``dedup``.  Only
DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.ranking import prefix_sums
from tidewatch.llm.mixing import WORD
from tidewatch.session import materialize

MIN_WORDS = 5
BROADCAST_LINES = 1_000_000  # deleted lines up to which the list of them is broadcast


def _place(key: str, text: str) -> Column:
    """Names and orders the documents."""
    return F.struct(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("tie"))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, line, hash, words) of every line."""
    return (docs.where(F.length(text) > 0)
            .select(_place(key, text).alias("doc"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "_text"))
            .select("doc", "line", F.unhex(F.md5("_text")).alias("hash"), F.regexp_count("_text", F.lit(WORD)).alias("words")))


def _segments(lines: DataFrame) -> DataFrame:
    """Lines found at least twice with their rank by content: (doc, line, seg,
    end, words, rank).  seg is the first line of the segment, end the line
    after its last one."""
    known = lines.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranks = materialize(prefix_sums(known, ["hash"], ["n"]).select("hash", (F.col("cum_n") - F.col("n") + 1).alias("rank")), "line_ranks")
    again = lines.join(ranks, "hash").select("doc", "line", "words", "rank").dropDuplicates(["doc", "line"])
    by_doc = Window.partitionBy("doc").orderBy("line")
    gap = F.col("line") - F.row_number().over(by_doc)  # constant along neighbouring lines
    seg = Window.partitionBy("doc", "gap")
    return again.withColumn("gap", gap).withColumn("end", F.max("line").over(seg) + 1).drop("gap")


def interval_ranks(segments: DataFrame) -> DataFrame:
    """(doc, line, k, rank) of every suffix that agrees with another one in
    2**k lines inside its segment."""
    suffixes = segments.select("doc", "line", "end", "rank")  # latest rank of every suffix
    active = suffixes
    levels = [active.select("doc", "line", F.lit(0).alias("k"), "rank")]
    k = 0
    while True:
        step = 1 << k
        ahead = suffixes.select("doc", (F.col("line") - step).alias("line"), F.col("rank").alias("next"))
        pairs = active.join(ahead, ["doc", "line"], "left").withColumn("next", F.when(F.col("line") + step < F.col("end"), F.col("next")).otherwise(F.lit(0)))
        pairs = materialize(pairs, "pairs")
        per = materialize(pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")), "pair_counts")
        if per.where("n > 1 and next > 0").isEmpty():
            return _union(levels)
        sums = materialize(prefix_sums(per, ["rank", "next"], ["n"]), "pair_ranks")
        left = sums.groupBy("rank").agg(F.min(F.col("cum_n") - F.col("n")).alias("before"))
        new = sums.join(left, "rank").select("rank", "next", (F.col("rank") + F.col("cum_n") - F.col("n") - F.col("before")).alias("new"), "n")
        moved = materialize(pairs.join(new, ["rank", "next"]).select("doc", "line", "end", F.col("new").alias("rank"), F.col("n").alias("members"), "next"), "ranks")
        # suffixes that share an interval and whose next 2**k lines are inside the segment
        active = moved.where("members > 1 and next > 0").select("doc", "line", "end", "rank")
        k += 1
        levels.append(active.where(F.col("line") + (1 << k) <= F.col("end")).select("doc", "line", F.lit(k).alias("k"), "rank"))
        done = suffixes.join(moved.select("doc", "line"), ["doc", "line"], "left_anti")
        suffixes = materialize(done.unionByName(moved.select("doc", "line", "end", "rank")), "suffixes")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _windows(segments: DataFrame, min_words: int) -> DataFrame:
    """(doc, line, len): shortest windows of ``min_words`` words inside a
    segment, from each line forwards and from each line backwards.

    Running word counts never fall, so one sorted pass over line marks and
    goals finds them: a goal's window ends at the nearest mark passed before
    it.  Forwards the order is from the end, with all signs turned."""
    by = Window.partitionBy("doc", "end").orderBy("line")
    w = segments.select("doc", "line", "end", "words").withColumn("upto", F.sum("words").over(by))

    def event(forth: bool, at: Column, goal: bool) -> Column:
        sign = -1 if forth else 1
        return F.struct(F.lit(forth).alias("forth"), (sign * at).alias("at"), F.lit(goal).alias("goal"), (sign * F.col("line")).alias("place"))

    upto, before = F.col("upto"), F.col("upto") - F.col("words")
    events = F.array(event(True, upto, False), event(True, before + min_words, True), event(False, before, False), event(False, upto - min_words, True))
    events = w.select("doc", "end", F.explode(events).alias("e")).select("doc", "end", "e.*")
    passed = Window.partitionBy("doc", "end", "forth").orderBy("at", "goal", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = events.withColumn("mark", F.max(F.when(~F.col("goal"), F.col("place"))).over(passed)).where("goal and mark is not null")
    return found.select("doc", F.when(F.col("forth"), -F.col("place")).otherwise(F.col("mark")).alias("line"),
                        (F.col("place") - F.col("mark") + 1).alias("len")).distinct()


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line) of every line under a later copy; doc is (id, tie)."""
    segments = materialize(_segments(materialize(_lines(docs, key, text), "lines")), "segments")
    levels = interval_ranks(segments)
    windows = _windows(segments, min_words).withColumn("k", F.length(F.bin(F.col("len").cast("long"))) - 1)
    windows = windows.withColumn("tail", F.col("line") + F.col("len") - F.expr("shiftleft(1, k)"))
    named = (windows.join(levels.select("doc", "line", "k", F.col("rank").alias("front")), ["doc", "line", "k"])
             .join(levels.select("doc", F.col("line").alias("tail"), "k", F.col("rank").alias("back")), ["doc", "tail", "k"]))
    named = materialize(named.select("doc", "line", "len", "front", "back"), "windows")
    first = named.groupBy("len", "front", "back").agg(F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first, "first_windows")  # a plain exchange on both sides lets Spark split a frequent window
    later = (named.join(first, ["len", "front", "back"]).where(F.struct("doc", "line") > F.col("first"))
             .groupBy("doc", "line").agg(F.max(F.col("line") + F.col("len")).alias("reach")))
    upto = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = segments.select("doc", "line").join(later, ["doc", "line"], "left").withColumn("reach", F.max("reach").over(upto))
    return covered.where(F.col("reach") > F.col("line")).select("doc", "line")


def _per_document(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("_deleted"))


def report(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: (key, n_lines, n_deleted, deleted_lines): the deleted line
    numbers, counted from 0, ascending and comma-joined."""
    gone = _per_document(deleted_lines(docs, min_words, key, text))
    count = F.when(F.length(text) > 0, F.size(F.split(F.col(text), "\n", -1))).otherwise(F.lit(0)).cast("long")
    rows = docs.select(_place(key, text).alias("doc"), count.alias("n_lines"))
    return rows.join(gone, "doc", "left").select(
        F.col("doc.id").alias(key), "n_lines", F.coalesce(F.size("_deleted"), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce(F.array_join(F.col("_deleted").cast("array<string>"), ","), F.lit("")).alias("deleted_lines"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the deleted lines.  A document that loses all its words
    goes; ``n_chars``, where there is one, is counted anew for changed texts."""
    gone = _per_document(deleted_lines(docs, min_words, key, text))
    gone = materialize(gone.select(F.col("doc.id").alias("_id"), F.col("doc.tie").alias("_tie"), "_deleted"), "deleted")
    size = gone.agg(F.sum(F.size("_deleted"))).head()[0] or 0
    if size <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    # the columns of docs travel as one value, so that no name can clash
    rows = docs.select(F.struct("*").alias("row"))
    old = F.col("row")[text]
    same = F.col("row")[key].eqNullSafe(F.col("_id")) & (F.xxhash64(old) == F.col("_tie"))
    kept = F.array_join(F.filter(F.split(old, "\n", -1), lambda x, i: ~F.array_contains("_deleted", i)), "\n")
    cut = F.col("_deleted").isNotNull()
    joined = rows.join(gone, same, "left").withColumn("_new", F.when(cut, kept).otherwise(old)).where(~cut | F.col("_new").rlike(WORD))
    row = F.col("row").withField(text, F.col("_new"))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        row = row.withField("n_chars", F.when(cut, F.length("_new").cast(kind)).otherwise(F.col("row")["n_chars"]))
    return joined.select(row.alias("row")).select("row.*")
