"""Importance resampling towards a target distribution.

Words are runs of digits, ``a``-``z`` (after lowering A-Z) and non-ASCII
bytes.  A text's features are its words and its pairs of neighbouring words
(joined by one space), repeats counted; crc32 of a feature's bytes names one
of ``buckets`` buckets.  One pass per table counts buckets in arrays (a task
sends at most one number per bucket), and the driver turns the two arrays of
counts, whose length is a parameter, into an array of gains.  A second pass
scores every document from that array: the floored mean gain of its features
plus a keyed Gumbel draw, so that taking the highest scores samples without
replacement in proportion to exp(weight / 1000).

The cut is found by bisection over numbers: jobs over the written scores count
rows exactly, sixteen equal parts of the remaining range at a time, first over
the score and then, among the rows tied with the cut score, over the document
id.  Only the counts of a job reach the driver, and no row is sorted for it.
The selected rows alone are range-partitioned for their ranks.

A null text has no features (weight 0).  A null id draws as an empty one and
comes after all others among equal scores; rows equal in score and id take
the places left in order of a hash of their text, then in any order.  A table
without documents of ``min_words`` words, or a share that rounds to none,
draws nobody.  An empty target makes every gain depend on the corpus alone.
Ids are integers.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.ranking import global_index
from tidewatch.llm.common import Words, slices
from tidewatch.session import materialize

BUCKETS = 10_000
MIN_WORDS = 20
PARTS = 16          # parts of the remaining range that one count job tells apart
LONG_WORD = 64      # bytes from which a word goes through zlib instead of the column loop
_ONES = np.uint32(0xFFFFFFFF)

_WORD_BYTES = np.zeros(256, dtype=bool)
_WORD_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    """Next state of crc32 for each byte, from its polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_TABLE = _crc_table()


def _crc(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 states carried on over the bytes of one word each."""
    state = state.copy()
    left = ends - starts
    for i in np.flatnonzero(left > LONG_WORD).tolist():
        state[i] = np.uint32(zlib.crc32(data[starts[i]:ends[i]], int(state[i] ^ _ONES))) ^ _ONES
    active = np.flatnonzero(left <= LONG_WORD)
    at, left = starts[active], left[active]
    while len(active):
        now = state[active]
        state[active] = _TABLE[(now ^ data[at]) & np.uint32(255)] ^ (now >> np.uint32(8))
        more = np.flatnonzero(left > 1)
        active, at, left = active[more], at[more] + 1, left[more] - 1
    return state


class Features:
    """Buckets of the features of some texts: ``single`` per word, ``pair``
    per word that another follows in its text (``first``: its number)."""

    def __init__(self, col: pa.Array, buckets: int):
        w = Words(col, lower=True, word_bytes=_WORD_BYTES)
        n = len(w.starts)
        self.words = np.diff(w.bounds)
        last = np.zeros(n, dtype=bool)
        last[w.bounds[1:][self.words > 0] - 1] = True
        self.first = np.flatnonzero(~last)
        self.bounds = w.bounds
        one = _crc(np.full(n, _ONES), w.data, w.starts, w.ends)
        spaced = one[self.first]
        spaced = _TABLE[(spaced ^ np.uint32(0x20)) & np.uint32(255)] ^ (spaced >> np.uint32(8))
        two = _crc(spaced, w.data, w.starts[self.first + 1], w.ends[self.first + 1])
        self.single = ((one ^ _ONES) % np.uint32(buckets)).astype(np.int64)
        self.pair = ((two ^ _ONES) % np.uint32(buckets)).astype(np.int64)

    def counts(self) -> np.ndarray:
        """Features of each text."""
        return self.words + np.maximum(self.words - 1, 0)

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """Sum of gains of each text."""
        per_word = gains[self.single]
        per_word[self.first] += gains[self.pair]
        upto = np.concatenate([[0], np.cumsum(per_word)])
        return upto[self.bounds[1:]] - upto[self.bounds[:-1]]


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of a table."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in slices(batches, "_text"):
            f = Features(b.column(0), buckets)
            total += np.bincount(f.single, minlength=buckets) + np.bincount(f.pair, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    sent = docs.select(F.col(text).alias("_text")).mapInArrow(count, "bucket long, n long")
    return sent.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket from the (bucket, n) tables of both sides."""
    def array(counts: DataFrame) -> list[int]:
        out = [0] * buckets
        for r in counts.collect():  # one row per bucket at most
            out[r.bucket] = r.n
        return out

    s, t = array(corpus), array(target)
    in_s, in_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1) * in_s / ((a + 1) * in_t))) for a, b in zip(s, t)], dtype=np.int64)


def score(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """One row per document: (key, tie, n_words, n_features, weight, score);
    tie is a hash of the text."""
    buckets = len(gain)

    def draw(doc) -> int:
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            f = Features(b.column(2), buckets)
            n = f.counts()
            weight = f.sums(gain) // np.maximum(n, 1)
            noise = np.array([draw(d) for d in b.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(x) for x in (f.words, n, weight, weight + noise))],
                ["doc", "tie", "n_words", "n_features", "weight", "score"])

    sent = docs.select(F.col(key).cast("long").alias("_doc"), F.xxhash64(text).alias("_tie"), F.col(text).alias("_text"))
    rows = sent.mapInArrow(judge, "doc long, tie long, n_words long, n_features long, weight long, score long")
    return rows.withColumnRenamed("doc", key)


def _cut(rows: DataFrame, value: str, wanted: int) -> tuple[int, int]:
    """(cut, above): the largest number that at least ``wanted`` >= 1 values
    reach, and how many are greater."""
    ends = rows.agg(F.min(value), F.max(value)).head()
    low, high, above = ends[0], ends[1] + 1, 0  # low is reached by enough values, high is not
    while high - low > 1:
        marks = sorted({low + (high - low) * i // PARTS for i in range(1, PARTS)} - {low})
        reached = rows.agg(*[F.count_if(F.col(value) >= m) for m in marks]).head()
        for m, n in zip(marks, reached):
            if n >= wanted:
                low = m
            else:
                high, above = m, n
                break
    return low, above


def draw(scored: DataFrame, percent: int = 25, min_words: int = MIN_WORDS, key: str = "doc_id") -> DataFrame:
    """``scored`` with the rank (1 is the highest score) of each of the
    ``percent`` of the documents with ``min_words`` words that are drawn."""
    scored = materialize(scored, "scores")
    rows = scored.where(F.col("n_words") >= min_words)
    wanted = rows.count() * percent // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    cut, above = _cut(rows, "score", wanted)
    in_cut = rows.where(F.col("score") == cut)
    # smaller ids first: among the tied rows, bisect their negatives; null ids come last
    ids = in_cut.where(F.col(key).isNotNull()).select((-F.col(key)).alias("_turned"))
    if wanted - above <= ids.count():
        last = -_cut(ids, "_turned", wanted - above)[0]
        tied = F.col(key).isNotNull() & (F.col(key) <= last)
    else:
        tied = F.lit(True)
    chosen = (F.col("n_words") >= min_words) & ((F.col("score") > cut) | ((F.col("score") == cut) & tied))
    chosen = F.coalesce(chosen, F.lit(False))
    ranked = global_index(scored.where(chosen), [F.col("score").desc(), F.col(key).asc_nulls_last(), "tie"], "_at")
    # rows equal to the last one in score and id may be more than the places left
    place = F.when(F.col("_at") < wanted, F.col("_at") + 1).cast("long")
    ranked = materialize(ranked.withColumn("rank", place).drop("_at"), "ranked")
    return ranked.unionByName(scored.where(~chosen).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = MIN_WORDS, seed: int = 7,
             buckets: int = BUCKETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score ``docs`` towards the texts of ``target`` and draw: (key, tie,
    n_words, n_features, weight, score, rank) per document."""
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets), buckets)
    return draw(score(docs, gain, key, text, seed), percent, min_words, key)


def drawn_documents(docs: DataFrame, ranked: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``ranked`` has drawn.
    Rows equal in id and text are all kept if one of them is drawn."""
    names = ranked.where("rank is not null").select(F.col(key).alias("_id"), F.col("tie").alias("_tie")).distinct()
    rows = docs.select(F.struct("*").alias("row"))  # one value, so that no name can clash
    same = F.col("row")[key].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("row")[text]) == F.col("_tie"))
    return rows.join(names, same, "left_semi").select("row.*")
