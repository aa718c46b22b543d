"""Divergence audit of sources: how each source's words differ from the others'.

Terms are runs of ASCII letters and non-ASCII bytes, A-Z in lower case.  Texts
are counted by term digest: a task sends (lang, source, digest, occurrences,
documents), so every shuffle of the counting carries fixed-width digests and
never a term.  A second pass over the texts names the digests of kept terms:
each task sends a term once per digest and slice, rows of other digests go
before any shuffle, and the smallest and largest string of a digest tell
whether two terms share it.  The terms of such a digest are counted again by
string and take part as terms of their own (``tag``).  Texts are joined back
only to the rows of the result, by digest.

Probabilities and divergences are whole numbers (see ``probability`` and
``divergence``).  Sums over all kept terms of a pair of sources are formed
from blocks of terms: a block holds the counts of one slice of a language's
digests in two tiles of ``TILE`` sources, sent in place of any pair of rows,
and leaves one sum per pair of sources.  Terms that neither source has are
not touched: their common value enters once, times their number.

A null lang, source or text is an empty one.  Every row is a document of its
own, whatever its id.  A language without kept terms has pairs of value 0 and
no terms; a language with one source has no pairs.  An empty table gives an
empty one.  Ties are broken by the bytes of the item.  Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Words, slices
from tidewatch.session import materialize

SCALE = 1_000_000_000
SMOOTH = 2
MIN_DOCS = 10
TOP = 10
TILE = 256                  # sources of a language that a block holds twice
BLOCK_ROWS = 200_000        # rows of counts that a block holds, about
HELD = 1_000_000            # counts that a counting task holds before it sends them
SLICE = 4 << 20             # bytes of text looked at together
BROADCAST_DIGESTS = 4_000_000  # kept digests up to which their list is broadcast (32 MB)
CELLS = 1 << 21             # cells of a block's dense part

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _plain(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _merged(group: np.ndarray, digest: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((digest, group))
    group, digest = group[order], digest[order]
    at = _runs(group, digest)
    return group[at], digest[at], *(np.add.reduceat(c[order], at) if len(at) else c for c in counts)


def digest_counts(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(lang, source, digest, n, docs): occurrences and documents of digests,
    from (lang, source, text)."""
    mask = _mask(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def send() -> pa.RecordBatch:
            group, digest, n, d = _merged(*(np.concatenate(x) for x in zip(*held)))
            known = list(names)
            which = pa.array(group, pa.int32())
            lang, source = (pa.array([k[i] for k in known], pa.string()).take(which) for i in (0, 1))
            held.clear()
            names.clear()
            return pa.RecordBatch.from_arrays([lang, source, pa.array(digest.view(np.int64)), pa.array(n), pa.array(d)], ["lang", "source", "digest", "n", "docs"])

        size = 0
        for b in slices(batches, "text", SLICE):
            w = Words(b.column(2), lower=True, word_bytes=_LETTERS)
            group = np.array([names.setdefault(k, len(names)) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], dtype=np.int64)
            row = np.repeat(np.arange(b.num_rows), np.diff(w.bounds))
            row, digest, n = _merged(row, w.hashes() & mask, np.ones(len(row), dtype=np.int64))
            held.append(_merged(group[row], digest, n, np.ones(len(row), dtype=np.int64)))
            size += len(held[-1][0])
            if size > HELD and len(held) > 1:
                held[:] = [_merged(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
            if size > HELD // 2 and len(held) == 1:
                yield send()
                size = 0
        if held:
            yield send()

    sent = docs.mapInArrow(count, "lang string, source string, digest long, n long, docs long")
    return sent.groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _spelled(docs: DataFrame, bits: int) -> DataFrame:
    """(digest, term): every term of a slice of texts once, told apart by
    another hash where the digest is shared."""
    mask = _mask(bits)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            w = Words(b.column(b.schema.get_field_index("text")), lower=True, word_bytes=_LETTERS)
            digest, other = w.hashes() & mask, w.hashes(seed=1)
            order = np.lexsort((other, digest))
            at = order[_runs(digest[order], other[order])]
            data = w.data.tobytes()
            terms = [data[s:e] for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(digest[at].view(np.int64)), pa.array(terms, pa.binary()).cast(pa.string())], ["digest", "term"])

    return docs.select("text").mapInArrow(spell, "digest long, term string")


def _term_counts(docs: DataFrame, digests: DataFrame, bits: int) -> DataFrame:
    """(lang, source, digest, tag, n, docs) by string, of shared digests only."""
    mask = _mask(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 18):
            w = Words(b.column(2), lower=True, word_bytes=_LETTERS)
            data = w.data.tobytes()
            terms = [data[s:e].decode() for s, e in zip(w.starts.tolist(), w.ends.tolist())]
            rows = pd.DataFrame({"row": np.repeat(np.arange(b.num_rows), np.diff(w.bounds)), "tag": terms, "digest": (w.hashes() & mask).view(np.int64)})
            per = rows.groupby(["row", "digest", "tag"], as_index=False).size()
            at = pa.array(per["row"].to_numpy(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(per["digest"].to_numpy(np.int64)),
                                              pa.array(per["tag"].tolist(), pa.string()), pa.array(per["size"].to_numpy(np.int64))],
                                             ["lang", "source", "digest", "tag", "n"])

    sent = docs.mapInArrow(count, "lang string, source string, digest long, tag string, n long")
    return sent.join(digests, "digest", "left_semi").groupBy("lang", "source", "digest", "tag").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, source, digest, tag, n) of the terms that ``min_docs``
    documents of their language have, and names (digest, tag, term).  tag is
    the term where its digest is shared, else empty."""
    counts = materialize(digest_counts(docs, bits), "digest_counts")

    def frequent(c: DataFrame, *by: str) -> DataFrame:
        often = c.groupBy("lang", *by).agg(F.sum("docs").alias("_docs")).where(F.col("_docs") >= min_docs).drop("_docs")
        return c.join(often, ["lang", *by], "left_semi")

    kept = materialize(frequent(counts, "digest"), "kept_counts")
    listed = materialize(kept.select("digest").distinct(), "kept_digests")
    spelled = _spelled(docs, bits)
    side = F.broadcast(listed) if listed.count() <= BROADCAST_DIGESTS else listed
    names = spelled.join(side, "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("other"))
    names = materialize(names, "names")
    kept, alone = kept.withColumn("tag", F.lit("")), names.select("digest", F.lit("").alias("tag"), "term")
    shared = names.where("term <> other").select("digest")
    if shared.isEmpty():
        return kept.select("lang", "source", "digest", "tag", "n"), alone
    shared = materialize(shared, "shared_digests")
    split = materialize(frequent(_term_counts(docs, shared, bits), "digest", "tag"), "split_counts")
    kept = materialize(kept.join(shared, "digest", "left_anti").select("lang", "source", "digest", "tag", "n")
                       .unionByName(split.select("lang", "source", "digest", "tag", "n")), "kept_terms")
    both = alone.join(shared, "digest", "left_anti").unionByName(split.select("digest", "tag", F.col("tag").alias("term")).distinct())
    return kept, materialize(both, "term_names")


def probability(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)) of columns,
    exactly; null where there are no terms."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({n} + {SMOOTH} as decimal(19,0)) "
                  f"div cast(nullif({total} + {SMOOTH} * {terms}, 0) as decimal(19,0))")


def divergence(p: str, q: str) -> Column:
    """floor((p - q)**2 / (p + q)) of columns."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def _divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, nth, total, terms, sources, blocks, rest) of every group
    that occurs: nth numbers the sources of a language, total is the sum of
    counts over kept terms, terms their number in the language, blocks the
    number of slices of its digests, rest the p of a term that is not there."""
    per = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("_rows"))
    terms = kept.select("lang", "digest", "tag").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    by = Window.partitionBy("lang")
    g = docs.select("lang", "source").distinct().join(per, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "terms", "_rows"])
    g = g.withColumn("nth", F.row_number().over(by.orderBy("source")) - 1).withColumn("sources", F.count(F.lit(1)).over(by))
    g = g.withColumn("blocks", F.ceil(F.sum("_rows").over(by) / BLOCK_ROWS).cast("int")).drop("_rows")
    return materialize(g.withColumn("rest", probability("0L", "total", "terms")), "groups")


def _blocks(tile_size: int, cells: int):
    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Sums over the terms of one slice for the pairs of sources of two tiles:
        what they have above the value of a term that neither has."""
        lang, i, j, above = None, *np.zeros((3, 0), dtype=np.int64)
        if len(left) and len(right):
            right = right.sort_values("nth")
            nth, rest = right["nth"].to_numpy(), right["rest"].to_numpy(np.int64)
            first, second = right["first"].iloc[0], right["second"].iloc[0]
            row = np.searchsorted(nth, left["nth"].to_numpy())
            col = pd.factorize(pd.MultiIndex.from_frame(left[["digest", "tag"]]))[0]
            order = np.argsort(col, kind="stable")
            row, col, p = row[order], col[order], left["p"].to_numpy(np.int64)[order]
            total = np.zeros((len(nth), len(nth)), dtype=np.int64)
            none = _divergences(rest[:, None], rest[None, :])
            width = max(1, cells // len(nth))
            for c in range(0, int(col[-1]) + 1, width):
                at = slice(*np.searchsorted(col, [c, c + width]))
                dense = np.repeat(rest[:, None], min(width, int(col[-1]) + 1 - c), axis=1)
                dense[row[at], col[at] - c] = p[at]
                for i in range(len(nth) - 1):
                    total[i, i + 1:] += _divergences(dense[i], dense[i + 1:]).sum(axis=1) - dense.shape[1] * none[i, i + 1:]
            i, j = np.triu_indices(len(nth), 1)
            tile = nth // tile_size
            own = (tile[i] == first) & (tile[j] == second)
            i, j = i[own], j[own]
            lang, above = left["lang"].iloc[0], total[i, j]
            i, j = nth[i], nth[j]
        return pd.DataFrame({"lang": pd.Series([lang] * len(i), dtype=object), "a": i, "b": j, "above": above})

    return block


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each source and each other source of
    its language."""
    tiles = F.explode(F.sequence(F.lit(0), ((F.col("sources") - 1) / TILE).cast("int")))
    own = (F.col("nth") / TILE).cast("int")
    cell = [F.least("_own", "_tile").alias("first"), F.greatest("_own", "_tile").alias("second")]
    rows = kept.join(groups, ["lang", "source"]).where("sources > 1").withColumn("p", probability("n", "total", "terms"))
    rows = rows.select("lang", "digest", "tag", "nth", "p", F.pmod("digest", F.col("blocks").cast("long")).alias("block"), own.alias("_own"), tiles.alias("_tile"))
    rows = rows.select("lang", "block", *cell, "digest", "tag", "nth", "p")
    side = groups.where("sources > 1 and blocks > 0").select("lang", F.col("nth").alias("nth"), "rest", own.alias("_own"), tiles.alias("_tile"), "blocks")
    side = side.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("blocks") - 1).cast("long"))).alias("block"), *cell, "nth", "rest")
    by = ["lang", "block", "first", "second"]
    above = rows.groupBy(*by).cogroup(side.groupBy(*by)).applyInPandas(_blocks(TILE, CELLS), "lang string, a int, b int, above long")
    above = above.groupBy("lang", "a", "b").agg(F.sum("above").alias("above"))
    g = groups.select("lang", "source", "nth", "rest", "terms")
    others = groups.select(F.col("lang").alias("lang"), F.col("source").alias("item"), F.col("nth").alias("_nth"), F.col("rest").alias("_rest"))
    pairs = g.join(others, "lang").where(F.expr("nth <> _nth"))
    pairs = pairs.withColumn("a", F.expr("least(nth, _nth)")).withColumn("b", F.expr("greatest(nth, _nth)")).join(above, ["lang", "a", "b"], "left")
    none = F.coalesce(F.col("terms") * divergence("rest", "_rest"), F.lit(0))
    return pairs.select("lang", "source", "item", (none + F.coalesce("above", F.lit(0))).cast("long").alias("value"))


def telling_terms(kept: DataFrame, names: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the ``top`` terms that a source has
    more often than its language."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("_total"))
    in_lang = kept.groupBy("lang", "digest", "tag").agg(F.sum("n").alias("_n")).join(whole, "lang")
    rows = kept.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"]).join(in_lang, ["lang", "digest", "tag"])
    rows = rows.withColumn("p", probability("n", "total", "terms")).withColumn("q", probability("_n", "_total", "terms")).where("p > q")
    rows = materialize(rows.select("lang", "source", "digest", "tag", divergence("p", "q").alias("value")), "term_values")
    # values reach the place ``top`` before their terms have texts: all rows of that value stay
    group = ["lang", "source"]
    upto = Window.partitionBy(*group).orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    values = rows.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    rows = rows.join(values.where(F.col("_before") < top).select(*group, "value"), [*group, "value"])
    rows = rows.join(names, ["digest", "tag"]).withColumnRenamed("term", "item")
    place = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).select(*group, "item", "value", "rank")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, bits: int = 64,
          lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other
    sources of a language by divergence, part ``term`` the telling terms.

    ``bits`` is the width of a digest; results do not depend on it."""
    docs = _plain(docs, lang, source, text)
    kept, names = kept_terms(docs, min_docs, bits)
    groups = _groups(docs, kept)
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = materialize(source_pairs(kept, groups), "pairs").withColumn("rank", F.row_number().over(by))
    terms = telling_terms(kept, names, groups, top)
    out = [materialize(d.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")), part)
           for part, d in (("pair", pairs), ("term", terms))]
    return out[0].unionByName(out[1])
