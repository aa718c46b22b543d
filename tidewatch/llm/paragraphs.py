"""Substring dedup: near-copies of passages by MinHash banding of paragraphs.

The words of a text (ASCII letters in lower case) are cut into paragraphs where
their content says so, whatever the lines: a word starts a paragraph if the
number drawn from it and its successor is the least among the ``RADIUS`` words
on either side (the first of equal ones).  Paragraphs have RADIUS + 1 words or
more, about twice as many on average, and a passage that two texts share holds
the same cuts in both, but for about RADIUS words at its ends.  So a repeated
passage is found across and inside lines, as the paragraphs it holds.  Texts of
up to 2 * RADIUS + 1 words are one paragraph; one of fewer than ``min_words``
words is none.

The set of a paragraph is its distinct five-word shingles.  Paragraphs with
equal sets are one class.  A class has 36 MinHash values in 12 bands of 3: a
pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**3)**12 =
0.9998, a pair of 0.3 with 0.28.  Band hashes travel packed, a hash range per
row.  Of up to ``SMALL`` classes with one band hash
all pairs are candidates and verified by the exact Jaccard similarity (80 % or
more).  Classes that share a band hash with more are large: all of them go
through the exact join of ``jaccard`` together, so that no pair is left out
and pairs do not grow with the square of a group of copies.  Links are joined
into components, and all paragraphs of a component but its first one (by
document id and place) are removed.

Null and empty texts have no paragraphs.  Rows without an id take part only
by their sets: they are removed if any row with an id has the same set.
Rows with one id are one document; equal paragraphs of it are copies.  An empty
table gives an empty table.  Extra columns are carried through ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.components import connected_components
from tidewatch.llm.common import Words, mix, slices
from tidewatch.llm.jaccard import BROADCAST_ROWS, PACKED, jaccard_components, packed_rows, range_bits, verified
from tidewatch.session import materialize

MIN_WORDS = 5
RADIUS = 10
BANDS, ROWS = 12, 3
SMALL = 8
FLUSH = 500_000  # band hashes that a task holds before it ships them

_DRAWS = np.random.default_rng(20)
_A = _DRAWS.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAWS.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_PRIME = (1 << 31) - 1


def _numbers(w: Words) -> np.ndarray:
    """The number of each word from its length and first eight bytes, squared
    so that words that differ little get numbers far apart."""
    length = w.ends - w.starts
    padded = np.concatenate([w.data, np.zeros(8, np.uint8)])
    h = length % _PRIME
    for j in range(8):
        h = (h * 257 + np.where(length > j, padded[w.starts + j], 0)) % _PRIME
    return h * h % _PRIME


def _cuts(w: Words) -> np.ndarray:
    """Bounds of paragraphs as places in the words; empty texts have none."""
    n = np.diff(w.bounds)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(doc)) - w.bounds[:-1][doc]
    left = n[doc] - at
    own = _numbers(w)
    after = np.append(own[1:], 0)[:len(own)]
    draw = (own * 48271 + np.where(left > 1, after, 0) * 16807) % _PRIME
    cut = (at > RADIUS) & (left > RADIUS)  # no window reaches into another text
    for d in range(1, RADIUS + 1):
        cut[d:] &= draw[d:] < draw[:-d]
        cut[:-d] &= draw[:-d] <= draw[d:]
    return np.unique(np.concatenate([w.bounds, np.flatnonzero(cut)]))


class Paragraphs:
    """Paragraphs of the texts of an Arrow column with their shingles.

    ``sets`` are the distinct shingles of paragraph i in ascending order, at
    ``bounds[i]:bounds[i+1]``."""

    def __init__(self, col: pa.Array, min_words: int):
        w = Words(col, lower=True)
        of_text, w.bounds = w.bounds, _cuts(w)
        shingles, bounds = w.shingles()
        first, last = w.bounds[:-1], w.bounds[1:]
        long = np.flatnonzero(last - first >= min_words)
        doc = np.searchsorted(of_text, first, "right") - 1
        self.doc = doc[long]
        self.piece = long - np.searchsorted(first, of_text[self.doc])
        self.data, self.bytes = w.data, np.stack([w.starts[first[long]], w.ends[last[long] - 1]], 1)
        chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        begin = chars[w.offsets[self.doc]]
        self.start, self.end = chars[self.bytes[:, 0]] - begin, chars[self.bytes[:, 1]] - begin
        size = np.diff(bounds)
        part = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((shingles, part))
        shingles, part = shingles[order], part[order]
        new = np.ones(len(part), dtype=bool)
        new[1:] = (part[1:] != part[:-1]) | (shingles[1:] != shingles[:-1])
        new &= (last - first >= min_words)[part]
        self.shingles, part = shingles[new], part[new]
        self.bounds = np.searchsorted(part, np.append(long, len(size)))

    def set(self, i: int) -> np.ndarray:
        return self.shingles[self.bounds[i]:self.bounds[i + 1]]

    def text(self, i: int) -> bytes:
        """A paragraph in lower case."""
        return self.data[self.bytes[i, 0]:self.bytes[i, 1]].tobytes()

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Halves of a 128-bit digest of each paragraph's set."""
        if not len(self.doc):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        halves = (np.add.reduceat(mix(self.shingles * a + b), self.bounds[:-1]) for a, b in ((_A[0], _B[0]), (_A[1], _B[1])))
        return tuple(mix(x).view(np.int64) for x in halves)

    def bands(self) -> np.ndarray:
        """One row of band hashes per paragraph."""
        out = np.empty((len(self.doc), BANDS), dtype=np.uint64)
        if not len(self.doc):
            return out
        for band in range(BANDS):
            h = np.full(len(self.doc), band + 1, dtype=np.uint64)
            for j in range(band * ROWS, (band + 1) * ROWS):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(self.shingles * _A[j] + _B[j], self.bounds[:-1]))
            out[:, band] = h
        return out


def paragraph_table(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, piece, start, end, class, check) of (id, text) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            p = Paragraphs(b.column(1), min_words)
            cols = [b.column(0).take(pa.array(p.doc)), *(pa.array(x.astype(np.int64)) for x in (p.piece, p.start, p.end, *p.classes()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "end", "class", "check"])

    return docs.mapInArrow(run, "id long, piece long, start long, end long, class long, check long")


def _groups(tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ordered tokens: its place in its group, and the group's size."""
    first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, int)
    size = np.diff(np.concatenate([first, [len(tok)]]))
    return np.arange(len(tok)) - np.repeat(first, size), np.repeat(size, size)


def candidates(docs: DataFrame, min_words: int, bits: int) -> DataFrame:
    """(a, b): classes with a band hash in common; a class of a large group is
    paired with itself, for all others of such groups.  A band hash is named by
    its range and 32 bits more: two that share a name only add candidates."""
    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, n = [], [], 0

        def flush() -> pa.RecordBatch:
            k, at = np.unique(np.concatenate(keys), return_index=True)  # copies have equal band hashes
            t, k = (np.concatenate(tokens)[at] >> np.uint64(32 - bits)).ravel(), np.repeat(k, BANDS)
            order = np.argsort(t)
            t, k = t[order], k[order]
            at, size = _groups(t)
            on = at <= SMALL  # one more than SMALL tells that the group is large
            large = np.unique(k[size > SMALL])
            t, k = t[on], k[on]
            where, names = t >> np.uint64(32), t.astype(np.uint32)
            first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            rows = [(int(where[a]), names[a:e].tobytes(), k[a:e].tobytes()) for a, e in zip(first, [*first[1:], len(where)])]
            if len(large):  # ranges below 0: classes of groups that are large already
                rows.append((-1 - int(large[0] % (1 << bits)), b"", large.tobytes()))
            return packed_rows(rows)

        for b in slices(batches, "text"):
            p = Paragraphs(b.column(0), min_words)
            tokens.append(p.bands())
            keys.append(p.classes()[0])
            n += tokens[-1].size
            if n >= FLUSH:
                yield flush()
                tokens, keys, n = [], [], 0
        if n:
            yield flush()

    def meet(t: pa.Table) -> pa.Table:
        key = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("extra").to_pylist()])
        if t.column("range")[0].as_py() < 0:
            large = np.unique(key)
            return pa.table({"a": pa.array(large), "b": pa.array(large)})
        tok = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("tokens").to_pylist()])
        order = np.lexsort((key, tok))
        tok, key = tok[order], key[order]
        new = np.ones(len(tok), dtype=bool)
        new[1:] = (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])
        tok, key = tok[new], key[new]
        at, size = _groups(tok)
        large = np.unique(key[size > SMALL])
        pairs = [np.stack([large, large], 1)]
        for d in range(1, SMALL):
            later = np.flatnonzero((size <= SMALL) & (at >= d))
            pairs.append(np.stack([key[later - d], key[later]], 1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return docs.select("text").mapInArrow(ship, PACKED).groupBy("range").applyInArrow(meet, "a long, b long").distinct()


def _texts_with(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text, wanted) of the documents with wanted places (id, wanted)."""
    per_doc = wanted.groupBy("id").agg(F.collect_list("wanted").alias("wanted"))
    few = wanted.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(per_doc) if few else per_doc, "id").select("id", "text", "wanted")


def large_links(docs: DataFrame, places: DataFrame, min_words: int) -> DataFrame:
    """(a, b): classes and the least class of their component, by the exact
    join of all classes (class, check, place)."""
    place = F.col("place")
    texts = _texts_with(docs, places.select("place.id", F.col("place.piece").alias("wanted")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            p = Paragraphs(b.column(1), min_words)
            wanted, ids, out = [set(x) for x in b.column("wanted").to_pylist()], b.column(0).to_pylist(), []
            for i, (d, at, first, second) in enumerate(zip(p.doc.tolist(), p.piece.tolist(), *(c.tolist() for c in p.classes()))):
                if at in wanted[d]:
                    out.append((ids[d], at, first, second, p.text(i)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["id", "piece", "class", "check", "content"])

    found = texts.mapInArrow(run, "id long, piece long, class long, check long, content binary")
    found = found.select(F.struct("id", "piece").alias("place"), "class", "check", F.col("content").cast("string").alias("text"))
    # a place has several texts if rows share an id: only the class's own one
    own = found.join(places.select("class", "check", place), ["class", "check", "place"], "left_semi").dropDuplicates(["class", "check"])
    own = materialize(own.select("class", "text"), "large")
    comps = jaccard_components(own, "class", "text")
    return comps.where(F.col("class") != F.col("component_id")).select(F.col("class").alias("a"), F.col("component_id").alias("b"))


def repeated_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per removed paragraph: (key, piece, start, end, first_doc_id,
    first_piece).  Positions are code points, end exclusive."""
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    bits = range_bits(docs)
    table = materialize(paragraph_table(docs, min_words), "paragraphs")
    place = F.struct("id", "piece")
    classes = materialize(table.groupBy("class", "check").agg(F.min(F.when(F.col("id").isNotNull(), place)).alias("place"), F.count(F.lit(1)).alias("copies"))
                          .where("place is not null"), "classes")
    pairs = materialize(candidates(docs, min_words, bits), "candidates")
    side = lambda c: classes.select(F.col("class").alias(c), F.col("place").alias(f"p{c}"))
    at_places = lambda df: df.join(side("a"), "a").join(side("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    large = pairs.where("a = b").select(F.col("a").alias("class"))
    large = materialize(classes.select("class", "check", "place").join(large, "class", "left_semi"), "large_classes")
    # halves of a digest that two sets share only add candidates
    pairs = materialize(at_places(pairs.where("a <> b")), "pairs")
    wanted = materialize(pairs.select("a").union(pairs.select("b")).distinct().select("a.id", F.col("a.piece").alias("wanted")), "wanted")
    texts = _texts_with(docs, wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            p = Paragraphs(b.column(1), min_words)
            asked = [set(x) for x in b.column("wanted").to_pylist()]
            ids = b.column(0).to_pylist()
            out = [(ids[d], at, p.set(i).tobytes()) for i, (d, at) in enumerate(zip(p.doc.tolist(), p.piece.tolist())) if at in asked[d]]
            if out:
                i, at, s = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(at, pa.int64()), pa.array(s, pa.binary())], names=["id", "piece", "set"])

    full = materialize(texts.mapInArrow(sets, "id long, piece long, set binary").select(place.alias("place"), "set"), "sets")
    both = (pairs.join(full.select(F.col("place").alias("a"), F.col("set").alias("set_a")), "a")
            .join(full.select(F.col("place").alias("b"), F.col("set").alias("set_b")), "b"))
    links = materialize(verified(both), "links")
    if not large.isEmpty():
        links = links.union(materialize(at_places(large_links(docs, large, min_words)), "large_links"))
    comps = connected_components(links)
    joined = classes.join(comps, F.col("place") == F.col("node"), "left").withColumn("first", F.coalesce("comp", "place"))
    joined = materialize(joined.select("class", "check", "first", "copies", "comp"), "first")
    joined = joined.where("copies > 1 or comp is not null").select("class", "check", "first")
    gone = table.join(joined, ["class", "check"]).where(~place.eqNullSafe(F.col("first")))
    return gone.select(F.col("id").alias(key), "piece", "start", "end", F.col("first.id").alias("first_doc_id"), F.col("first.piece").alias("first_piece"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the removed paragraphs; the white space around them
    stays.  Rows without an id and rows that share an id but have different
    texts stay whole."""
    rows = docs.select(F.struct("*").alias("row"))  # one value, so that no name can clash
    one = docs.groupBy(F.col(key).alias("_key")).agg(F.min(text).alias("_text"), F.max(text).alias("_last"))
    one = one.where("_text = _last").select("_key", F.md5("_text").alias("_same"))
    gone = (repeated_paragraphs(docs, min_words, key, text).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
            .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_gone")).join(one, "_key"))
    old = F.col("row")[text]
    begins = F.concat(F.array(F.lit(0).cast("long")), F.col("_gone.end"))
    ends = F.concat(F.col("_gone.start"), F.array(F.char_length(old).cast("long")))
    kept = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(old, (a + 1).cast("int"), (b - a).cast("int"))), "")
    joined = rows.join(gone, (F.col("row")[key] == F.col("_key")) & (F.md5(old) == F.col("_same")), "left")
    return joined.select(F.col("row").withField(text, F.when(F.col("_gone").isNotNull(), kept).otherwise(old)).alias("row")).select("row.*")
