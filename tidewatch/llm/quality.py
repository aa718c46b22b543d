"""Quality rules: statistics of texts, hard limits, and an isolation forest.

Statistics come from the words of a whole text (see ``common``).  Two hard
limits reject a document outright: fewer than ten words, or more than a fifth
of its words inside five-word windows found twice or more.  The rest is
judged by an isolation forest over ratios of the statistics: trees of random
splits grown on a sample of labelled rows isolate unusual documents early.
The sample is bounded (``FIT_ROWS``, the smallest hashes of the ids); scores
and the threshold cover all rows: the threshold is the score cut that best
separates all labelled rows, good ones weighing ``KEEP_WEIGHT`` times as
much as bad ones.

A null or empty text has no words and fails the first limit.  Without
labelled rows of both classes there is no threshold and only the hard limits
reject.  Labels with a null id or class are not used; of repeated labels of
one id the lowest class counts.  Repeated rows get equal verdicts.  An empty
table gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Words, slices
from tidewatch.session import materialize

FIT_ROWS = 20_000  # labelled rows that the forest may be grown from
TREES, TREE_ROWS = 200, 256
KEEP_WEIGHT = 4.0  # a rejected good document counts as much as so many kept bad ones
BINS = 20_000  # score cuts that are weighed
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_HAS_WORD = b"\x20\x09\x0a\x0b\x0c\x0d"
_WINDOW = 5

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_part(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def _repeat_words(words: Words) -> np.ndarray:
    """Words of each text inside a window found twice or more in it."""
    h, bounds = words.shingles(_WINDOW)
    n_words = np.diff(words.bounds)
    out = np.zeros(len(n_words), dtype=np.int64)
    part = np.repeat(np.arange(len(n_words), dtype=np.uint64), np.diff(bounds))
    own = h ^ (part * np.uint64(0x9E3779B97F4A7C15))  # equal only within a text
    s = np.sort(own)
    again = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(again):
        return out
    at = np.searchsorted(again, own)
    at[at == len(again)] = 0
    hit = np.flatnonzero(again[at] == own)
    doc = part[hit].astype(np.int64)
    first = words.bounds[doc] + hit - bounds[doc]
    cover = np.zeros(words.bounds[-1] + _WINDOW + 1, dtype=np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + _WINDOW, -1)
    return _per_part(np.cumsum(cover)[:words.bounds[-1]] > 0, words.bounds)


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2 or len(set(lines)) == len(lines):
        return 0
    worded = [x for x in lines if x.strip(_HAS_WORD)]
    return len(worded) - len(set(worded))


def text_statistics(col: pa.Array) -> list[np.ndarray]:
    """The statistics of the texts of an Arrow column, in order."""
    w = Words(col)
    raw = w.data.tobytes()
    off = w.offsets.tolist()
    lines = np.array([_dup_lines(raw[x:y]) for x, y in zip(off[:-1], off[1:])], dtype=np.int64)
    chars = _per_part(w.is_word_byte & ((w.data & 0xC0) != 0x80), w.offsets)
    return [np.diff(w.bounds), chars, _per_part(_SYMBOLS[w.data], w.offsets), lines, _repeat_words(w)]


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            made = text_statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.astype(np.int64)) for x in made)], names=[key, *STATISTICS])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{s} long" for s in STATISTICS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Mean word length and shares of symbols, drawn towards the usual for
    short texts.  Repeats are left to their hard limit: a clean document that
    says a line twice is unusual, not bad."""
    n, chars, symbols = (stats[s].astype(np.float64) for s in STATISTICS[:3])
    return np.stack([(chars + 5.0 * 100) / (n + 100), symbols / (chars + 10), symbols / (n + 2)], axis=1)


class Forest:
    """Isolation trees as flat arrays; ``score`` is 2 ** (-mean path / usual path)."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        self.depth = int(np.ceil(np.log2(max(self.size, 2))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def usual(n: np.ndarray | float) -> np.ndarray:
        """Mean path length of an unsuccessful search among n rows."""
        n = np.asarray(n, dtype=np.float64)
        big = np.maximum(n, 3)
        return np.where(n > 2, 2 * (np.log(big - 1) + 0.5772156649015329) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, child, path = [], [], [], []

        def add(part: np.ndarray, depth: int) -> int:
            node = len(feature)
            feature.append(-1), cut.append(0.0), child.append((node, node)), path.append(depth + float(self.usual(len(part))))
            low, high = part.min(axis=0), part.max(axis=0)
            open_to = np.flatnonzero(high > low)
            if depth < self.depth and len(part) > 1 and len(open_to):
                f = int(rng.choice(open_to))
                at = rng.uniform(low[f], high[f])
                left = part[:, f] <= at
                feature[node], cut[node] = f, at
                child[node] = (add(part[left], depth + 1), add(part[~left], depth + 1))
            return node

        add(rows, 0)
        return np.array(feature), np.array(cut), np.array(child), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for feature, cut, child, path in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = rows[at_row, np.maximum(f, 0)] > cut[node]
                node = child[node, right.astype(np.int64)]
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / max(float(self.usual(self.size)), 1e-9))


def _scored(stats: DataFrame, forest: Forest) -> DataFrame:
    held = stats.sparkSession.sparkContext.broadcast(forest)  # TREES x 2 x TREE_ROWS nodes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features({s: b.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.score(x))], names=[*b.schema.names, "score"])

    return stats.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in stats.dtypes) + ", score double")


def best_cut(per_bin: list[tuple[int, int, int]], keep_weight: float = KEEP_WEIGHT) -> float | None:
    """The score above which rows are rejected, from (bin, good rows, bad rows);
    None if either class is missing.  Among equally good cuts the middle of the
    widest gap counts."""
    rows = sorted(per_bin)
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return None
    best, cut, width, good_above, bad_above = -np.inf, None, 0, good, bad
    for i, (at, g, b) in enumerate(rows):  # the cut lies above this bin
        good_above, bad_above = good_above - g, bad_above - b
        value = bad_above / bad - keep_weight * good_above / good
        up = rows[i + 1][0] if i + 1 < len(rows) else at + 1
        if value > best or value == best and up - at > width:
            best, cut, width = value, (at + 1 + up) / 2 / BINS, up - at
    return cut


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
        fit_rows: int = FIT_ROWS, seed: int = 42) -> tuple[Forest | None, float | None]:
    """(forest, score cut) from written statistics and labels."""
    marks = (labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key"))
             .agg(F.min(label).alias("_good")))
    labelled = stats.where(~base_failed()).join(marks, stats[key] == F.col("_key"))
    # a slice of hashes that holds the sample, so that tasks send little more than it to the driver
    draw = F.xxhash64(F.lit(seed), "_key")
    share = min(1.0, 1.5 * fit_rows / max(labelled.count(), 1))
    some = labelled.where(F.pmod(draw, F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))
    drawn = some.select(*STATISTICS).orderBy(draw, *STATISTICS).limit(fit_rows).collect()
    if not drawn:
        return None, None
    rows = np.array(drawn, dtype=np.float64)
    forest = Forest(features({s: rows[:, i] for i, s in enumerate(STATISTICS)}), seed=seed)
    bins = (_scored(labelled.select(*STATISTICS, "_good"), forest)
            .groupBy(F.floor(F.col("score") * BINS).alias("bin"))
            .agg(F.sum("_good").alias("good"), F.sum(1 - F.col("_good")).alias("bad")))
    return forest, best_cut([tuple(r) for r in bins.collect()])  # one row per bin, BINS at most


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, the statistics, base_failed, score, kept) of every document."""
    stats = materialize(statistics(docs, key, text), "statistics")
    forest, cut = fit(stats, labels, key, label)
    judged = _scored(stats, forest) if forest else stats.withColumn("score", F.lit(None).cast("double"))
    anomalous = F.lit(False) if cut is None else F.col("score") > cut
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~anomalous)


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The documents that ``judge`` keeps, with their columns.  Verdicts are
    reached again where the texts are, so that no text is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(fit(materialize(statistics(docs, key, text), "statistics"), labels, key, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, cut = held.value
        for b in slices(batches, text):
            stats = dict(zip(STATISTICS, text_statistics(b.column(b.schema.get_field_index(text)))))
            good = (stats["n_words"] >= 10) & (100 * stats["n_repeat_words"] <= 20 * stats["n_words"])
            if cut is not None:
                good &= forest.score(features(stats)) <= cut
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
