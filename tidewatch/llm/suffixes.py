"""Removal of bytes under repeated strings by collection suffix order.

A byte goes if a string of ``DEPTH`` bytes that covers it also starts in a
document with a smaller id.  The order of suffixes that tells equal strings is
built column by column over many short strings at once: round j inserts the
suffixes that begin j bytes further ahead, by one stable distribution of the
suffixes of the round before on the symbol in front of them (the suffixes that
begin with a symbol stand in the order of their tails).  Neighbours with
``DEPTH`` common symbols form an interval, and the smallest document of an
interval is an earlier holder of its strings.

Whole documents would need as many rounds as the longest has bytes, each over
the whole corpus.  So texts are first cut where their content says: every
window of ``DEPTH`` bytes names an anchor of ``ANCHOR`` bytes inside it, by the
least of its hashed ``TMER``-byte strings modulo the room that the anchor has
(a sampling scheme that depends on the window's bytes alone), and consecutive
windows with one anchor make a *piece* of less than 2 * DEPTH bytes.  Equal
windows have equal anchors at equal places, so only suffixes that begin as far
before their anchors need an order among themselves, and a piece is its anchor
with ``REACH`` bytes at most on each side:

1. a document whose whole text an earlier one has goes whole; anchors that two
   of the others name are counted and set bits of a bitmap of ``MAX_BITS`` at
   most, by which the tasks that cut the texts drop most occurrences of other
   anchors before any shuffle (a fuller bitmap lets more of them through, which
   the next steps then drop);
2. of equal pieces a task sends only those of their smallest document, the
   others are covered by them; an anchor with a single piece is solved by that;
3. the different pieces of an anchor, in buckets of about ``BUCKET`` bytes of
   text, go through the column-wise construction: the columns behind the
   anchors, from the last one on, then a round for each place before them;
4. an anchor with more than ``HOT`` pieces would make a hot bucket: its
   pieces are cut into windows, which are spread and met by their digests.

Tasks send rows as compressed blocks, one for each bucket.  Equality of 64-bit
hashes stands for equality of anchors and pieces (128 bits together).  A null
text is empty.  A null id comes after all ids; documents with one id are not
earlier than each other, and rows equal in id and text are cut alike.  Texts
shorter than ``DEPTH`` keep all bytes.  Empty tables give empty tables.  Ids
are integers.  ``dedup`` carries extra columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import mix, slices, string_parts
from tidewatch.session import materialize

DEPTH = 50
ANCHOR = 32
ROOM = DEPTH - ANCHOR + 1             # places of an anchor in a window
TMER = 4 + (ANCHOR - 4) % ROOM        # 13
REACH = DEPTH - ANCHOR                # bytes of a window beside its anchor
CHUNK = 1 << 16                       # window starts looked at together
HELD = 1_000_000                      # anchors that a task holds before it sends them
PIECES = 400_000                      # pieces, likewise
BUCKET = 1 << 21                      # bytes of text of a bucket, about
MAX_BUCKETS = 1 << 12
HOT = 4096                            # pieces of one anchor from which its windows are spread
SPREAD = 1 << 15                      # pieces cut into windows together
MAX_BITS = 1 << 28                    # bits of the bitmap of repeated anchors (32 MB)
BROADCAST_COPIES = 1_000_000          # whole copies up to which their list is broadcast
LAST = (1 << 63) - 1                  # stands for a null id
_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_PLACE = _U((1 << 21) - 1)
_KIND = _U((1 << 19) - 1)             # bits that tell the pieces of an anchor apart where they are counted
_NEAR = (np.arange(REACH) < np.arange(ROOM)[:, None]).astype(np.uint8)  # row k keeps the first k bytes
_FORE = _NEAR[:, ::-1]                # the last k bytes
_MARK = np.dtype([("id", "<u4"), ("n", "<u2")])
_PIECE = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("tie", "<i4"), ("start", "<i4"), ("at", "u1"), ("windows", "u1"), ("left", "u1", REACH), ("right", "u1", REACH)])
_CUT = np.dtype([("doc", "<i8"), ("tie", "<i4"), ("cut", "<i8")])
_BLOCKS = "bucket int, n int, block binary"


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _C2
    return x ^ (x >> _U(29))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        keys, have = np.minimum(keys[:-have], keys[have:]), 2 * have
    return np.minimum(keys[:len(keys) - (width - have)], keys[width - have:]) if width > have else keys


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start, windows, at, anchor, digest) of the pieces of some texts, in
    arrays: start is a byte of ``data``, the piece has windows + DEPTH - 1 bytes
    and its anchor ``at`` bytes before it."""
    windows_at = np.zeros(len(data) + 1, dtype=np.int64)  # texts end: no window starts in their last bytes
    np.add.at(windows_at, offsets[:-1], 1)
    np.add.at(windows_at, np.maximum(offsets[:-1], offsets[1:] - DEPTH + 1), -1)
    inside = np.cumsum(windows_at[:-1]) > 0
    for base in range(0, len(data) - DEPTH + 1, CHUNK):
        n = min(CHUNK, len(data) - DEPTH + 1 - base)
        valid = inside[base:base + n]
        part = np.concatenate([data[base:base + n + DEPTH - 1], np.zeros(8, np.uint8)])
        eight = _stir(np.ndarray((n + DEPTH - 1,), "<u8", part, 0, (1,)) * _C1)
        tmers = _stir(eight[:n + DEPTH - TMER] * _C1 + eight[TMER - 8:n + DEPTH - 8])
        least = _least((tmers & ~_PLACE) | np.arange(len(tmers), dtype=np.uint64), DEPTH - TMER + 1)
        at = np.arange(n)
        anchor_at = at + ((least & _PLACE).astype(np.int64) - at) % ROOM
        before = np.concatenate([[False], valid[:-1]])
        begins = valid & ~before
        begins[1:] |= valid[1:] & before[1:] & (anchor_at[1:] != anchor_at[:-1])
        edge = np.flatnonzero(begins | (before & ~valid))
        ends = np.concatenate([edge[1:], [n]])
        own = begins[edge]
        start, ends = edge[own], ends[own]
        if not len(start):
            continue
        sixteen = _stir(eight[:-8] * _C1 + eight[8:])
        long = _stir(sixteen[:-16] * _C1 + sixteen[16:])
        windows = ends - start
        size = windows + DEPTH - 1
        digest = mix(mix(long[start] * _C1 + long[start + size - ANCHOR]) * _C3 + sixteen[start + size // 2 - 8] + size.astype(np.uint64))
        yield np.searchsorted(offsets, base + start, "right") - 1, base + start, windows, anchor_at[start] - start, mix(long[anchor_at[start]]), digest


def _name(key: str, text: Column) -> list[Column]:
    """(doc, tie): the id, the largest for a null, and a hash that tells rows with one id apart."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.hash(text).alias("tie")]


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(*_name(key, F.col(text)), F.col(text).alias("text"))


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _bucket_of(bits: np.ndarray, buckets: int) -> np.ndarray:
    return (((bits & _U(0x1FFF)) * _U(buckets)) >> _U(13)).astype(np.uint16)


def _blocks(to: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """The rows for each bucket, byte by byte of a row, as a compressed block."""
    order = np.argsort(to, kind="stable")
    to, rows = to[order], rows[order]
    at = _groups(to) if len(to) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(to))[:len(at)]
    packed = [pa.compress(np.ascontiguousarray(rows[a:e].view(np.uint8).reshape(e - a, -1).T), codec="zstd", asbytes=True) for a, e in zip(at.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(to[at].astype(np.int32)), pa.array((ends - at).astype(np.int32)), pa.array(packed, pa.binary())], ["bucket", "n", "block"])


def _rows(table: pa.Table, kind: np.dtype) -> np.ndarray:
    """The rows of some blocks."""
    out = []
    for n, block in zip(table.column("n").to_pylist(), table.column("block").to_pylist()):
        raw = np.frombuffer(pa.decompress(block, n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).ravel())
    return np.concatenate(out)


def repeated_anchors(docs: DataFrame, buckets: int = 1, hot: int = HOT) -> DataFrame:
    """(bucket, anchor, hot) of the anchors that more than one document names,
    by their upper 32 bits and bucket; hot: more than ``hot`` pieces of it may
    be sent.  docs is (doc, tie, text)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> pa.RecordBatch:
            kind, doc = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(kind)
            kind, doc = kind[order], doc[order]
            anchor = kind & ~_KIND
            at = _groups(anchor)
            several = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
            new = np.zeros(len(kind), dtype=np.int64)
            new[_groups(kind)] = 1
            rows = np.empty(len(at), _MARK)
            rows["id"] = anchor[at] >> _U(32)
            rows["n"] = np.minimum(np.maximum(np.add.reduceat(new, at), several + 1), 0xFFFF)
            # an anchor with several pieces in one document is no repeated one
            rows["n"][~several & (rows["n"] > 1)] = 1
            return _blocks(_bucket_of(anchor[at] >> _U(19), buckets), rows)

        size = 0
        for b in slices(batches, "text"):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for row, _, _, _, anchor, digest in pieces(*string_parts(b.column(1))):
                held.append(((anchor & ~_KIND) | (digest & _KIND), ids[row]))
                size += len(anchor)
            if size > HELD:
                yield send()
                size = 0
        if held:
            yield send()

    def meet(table: pa.Table) -> pa.Table:
        rows = _rows(table, _MARK)
        rows = rows[np.argsort(rows["id"])]
        at = _groups(rows["id"])
        n = np.add.reduceat(rows["n"].astype(np.int64), at)
        found = n > 1
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array(np.full(found.sum(), bucket, np.int32)), "anchor": pa.array(rows["id"][at[found]].astype(np.int64)), "hot": pa.array(n[found] > hot)})

    return docs.select("doc", "text").mapInArrow(count, _BLOCKS).groupBy("bucket").applyInArrow(meet, "bucket int, anchor long, hot boolean")


def bitmap(anchors: DataFrame, most: int = MAX_BITS) -> np.ndarray:
    """Bytes of a bitmap, a power of two of bits, that marks the low bits of
    each anchor; 16 bits an anchor, ``most`` in all."""
    bits = min(most, max(1 << 15, 1 << (16 * anchors.count()).bit_length()))
    slot = F.col("anchor").bitwiseAND(F.lit(bits - 1)) + 1
    parts = anchors.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("map"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts.toLocalIterator():  # 4 KB each, bits / 32768 of them at most
        out[(r.part - 1) * 4096:r.part * 4096] = np.frombuffer(r.map, dtype=np.uint8)
    return out


def _alike(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, where, digest): an order with equal pieces together, where they begin, and their digests."""
    bytes_ = np.zeros((len(p), 2 * REACH + 4), dtype=np.uint8)
    bytes_[:, :REACH], bytes_[:, REACH:2 * REACH], bytes_[:, -2], bytes_[:, -1] = p["left"], p["right"], p["at"], p["windows"]
    digest = p["anchor"].copy()
    for eight in bytes_.view("<u8").T:
        digest = mix((digest ^ eight) * _C1)
    order = np.argsort(digest)
    return order, _groups(digest[order], p["anchor"][order]) if len(p) else order, digest


def _cuts(p: np.ndarray, mask: np.ndarray) -> np.ndarray:
    out = np.empty(len(p), _CUT)
    out["doc"], out["tie"], out["cut"] = p["doc"], p["tie"], (p["start"].astype(np.int64) << ROOM) | mask
    return out


def _whole(p: np.ndarray) -> np.ndarray:
    """The mask of all windows of each piece."""
    return (np.int64(1) << p["windows"].astype(np.int64)) - 1


def _send(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pieces, digests, cuts): of equal pieces only those of their smallest
    document are left, the others are cut whole."""
    if not len(p):
        return p, np.zeros(0, np.uint64), np.zeros(0, _CUT)
    order, at, digest = _alike(p)
    doc = p["doc"][order]
    late = doc > np.repeat(np.minimum.reduceat(doc, at), np.diff(np.append(at, len(p))))
    left, gone = np.sort(order[~late]), p[order[late]]
    return p[left], digest[left], _cuts(gone, _whole(gone))


def _windows(p: np.ndarray) -> np.ndarray:
    """Each window of the pieces as a piece."""
    n = p["windows"].astype(np.int64)
    out = np.repeat(p, n)
    nth = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
    ahead = out["at"] - nth
    out["start"] += nth.astype(np.int32)
    out["at"], out["windows"] = ahead, 1
    out["left"] *= _FORE[ahead]
    out["right"] *= _NEAR[REACH - ahead]
    return out


def _cut_bucket(cuts: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket_of(mix(cuts["doc"].view(np.uint64) ^ cuts["tie"].astype(np.uint64)), _cut_buckets(buckets))


def _cut_buckets(buckets: int) -> int:
    return -(-buckets // 8)


def occurrences(docs: DataFrame, marked: np.ndarray, hot: np.ndarray, buckets: int = 1) -> DataFrame:
    """Blocks of the pieces with a marked anchor, by buckets of their anchors,
    or of their windows, by buckets of these, where the anchor is hot (bucket
    and upper 32 bits in ``hot``, ascending); and from bucket ``buckets`` on,
    blocks of cuts for pieces that the task has in an earlier document."""
    last = _U(8 * len(marked) - 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            p, _, cuts = _send(np.concatenate(held))
            held.clear()
            yield _blocks(_cut_bucket(cuts, buckets) + np.uint16(buckets), cuts)
            to = _bucket_of(p["anchor"] >> _U(19), buckets)
            if len(hot):
                key = (to.astype(np.uint64) << _U(32)) | (p["anchor"] >> _U(32))
                wide = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                spread = p[wide]
                to, p = to[~wide], p[~wide]
                for a in range(0, len(spread), SPREAD):
                    w, digest, cuts = _send(_windows(spread[a:a + SPREAD]))
                    yield _blocks(_bucket_of(digest >> _U(32), buckets), w)
                    yield _blocks(_cut_bucket(cuts, buckets) + np.uint16(buckets), cuts)
            yield _blocks(to, p)

        size = 0
        for b in slices(batches, "text"):
            doc, tie = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = string_parts(b.column(2))
            beside = np.lib.stride_tricks.sliding_window_view(np.pad(data, REACH), REACH)
            for row, start, windows, at, anchor, _ in pieces(data, offsets):
                slot = (anchor >> _U(32)) & last
                seen = np.flatnonzero((marked[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1)
                row, start, windows, at, anchor = (x[seen] for x in (row, start, windows, at, anchor))
                p = np.empty(len(seen), _PIECE)
                p["anchor"], p["doc"], p["tie"], p["start"], p["at"], p["windows"] = anchor, doc[row], tie[row], start - offsets[row], at, windows
                p["left"] = beside[start + at] * _FORE[at]
                p["right"] = beside[start + at + ANCHOR + REACH] * _NEAR[windows + REACH - 1 - at]
                held.append(p)
                size += len(p)
            if size > PIECES:
                yield from send()
                size = 0
        if held:
            yield from send()

    return docs.mapInArrow(cut, _BLOCKS)


def owners_by_column(group: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray, windows: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """[string, k]: the smallest owner of a string that holds the same window
    with k symbols before the anchor; the largest integer where the string has
    no such window.  A string is an anchor (equal in a group), ``at`` symbols of
    ``left`` before it and symbols of ``right`` behind it; its first window has
    ``at`` symbols before the anchor, each other one less, and as many on both
    sides together as ``right`` has columns.

    Column-wise construction: ``order`` has the suffixes that begin k symbols
    before their anchors, ``name`` tells the different ones of these symbols,
    ``common`` is the prefix that the suffixes from the anchor on share with
    the one above (-1: not even the anchor), ``spot`` their places there."""
    count, reach = right.shape
    none = np.iinfo(owners.dtype).max
    out = np.full((count, left.shape[1] + 1), none, dtype=owners.dtype)
    if not count:
        return out
    order = np.arange(count)
    for column in range(reach - 1, -1, -1):
        order = order[np.argsort(right[order, column], kind="stable")]
    order = order[np.argsort(group[order], kind="stable")]
    behind, apart = right[order], group[order]
    differ = behind[1:] != behind[:-1]
    common = np.full(count, -1)
    common[1:] = np.where(apart[1:] != apart[:-1], -1, np.where(differ.any(axis=1), differ.argmax(axis=1), reach) if reach else 0)
    spot, name = np.arange(count), np.zeros(count, dtype=np.int64)
    for k in range(left.shape[1] + 1):
        if k:
            long = np.flatnonzero(at[order] >= k)
            if not len(long):
                break
            symbol = left[order[long], left.shape[1] - k]
            by = np.argsort(symbol, kind="stable")
            symbol, long = symbol[by], long[by]
            order, spot, name = order[long], spot[long], name[long]
            new = np.zeros(len(order), dtype=np.int64)
            new[_groups(symbol, name)[1:]] = 1
            name = np.cumsum(new)
        interval = _groups(name, np.cumsum(common < reach - k)[spot])
        before = at[order].astype(np.int64)
        least = np.minimum.reduceat(np.where((before >= k) & (before - windows[order] < k), owners[order], none), interval)
        out[order, k] = np.repeat(least, np.diff(np.append(interval, len(order))))
        short = (at < k) | (at.astype(np.int64) - windows >= k)
        out[short, k] = none
    return out


def earliest_owners(strings: list[bytes], owners: np.ndarray, depth: int = DEPTH) -> list[np.ndarray]:
    """For each string and each of its substrings of ``depth`` bytes in order,
    the smallest owner of a string that holds that substring."""
    count = np.array([max(len(s) - depth + 1, 0) for s in strings], dtype=np.int64)
    right = np.frombuffer(b"".join(s[i:i + depth] for s, n in zip(strings, count.tolist()) for i in range(n)), dtype=np.uint8).reshape(-1, depth)
    same = np.zeros(len(right), dtype=np.int64)
    least = owners_by_column(same, right[:, :0], right, same, same + 1, np.repeat(owners, count))
    return np.split(least[:, 0], np.cumsum(count)[:-1]) if len(strings) else []


def _masks(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, mask): the pieces with their order and the windows that an
    earlier document holds; p has all pieces with their anchors, or all
    windows equal to them."""
    order, at, _ = _alike(p)
    p = p[order]
    doc, size = p["doc"], np.diff(np.append(at, len(p)))
    first, last, anchor = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at), p["anchor"][at]
    by = np.argsort(anchor)
    of = _groups(anchor[by])
    kinds = np.diff(np.append(of, len(at)))
    met = np.minimum.reduceat(first[by], of) < np.maximum.reduceat(last[by], of)
    several = by[np.repeat(met & (kinds > 1), kinds)]
    slot = np.full(len(at), -1)
    slot[several] = np.arange(len(several))
    slot = np.repeat(slot, size)
    mask = np.where((slot < 0) & (doc > np.repeat(first, size)), _whole(p), 0)
    one = p[at[several]]
    group = np.repeat(np.arange(len(of)), kinds * (met & (kinds > 1)))
    least = owners_by_column(group, one["left"], one["right"], one["at"], one["windows"], first[several])
    asked = np.flatnonzero(slot >= 0)
    ahead, doc, slot, bits = p["at"][asked].astype(np.int64), doc[asked], slot[asked], np.zeros(len(asked), dtype=np.int64)
    for k in range(ROOM):
        bits |= (least[slot, k] < doc).astype(np.int64) << np.maximum(ahead - k, 0)
    mask[asked] = bits
    return p, mask


def covered_pieces(docs: DataFrame, buckets: int = 1, hot: int = HOT) -> DataFrame:
    """(doc, tie, cuts) of the documents with windows that an earlier document
    holds; a cut is the start of a piece * 2**ROOM + its mask, and bit i of the
    mask is set for the window i bytes on.  docs is (doc, tie, text)."""
    def solve(table: pa.Table) -> pa.Table:
        p, mask = _masks(_rows(table, _PIECE))
        cuts = _cuts(p[mask != 0], mask[mask != 0])
        return pa.Table.from_batches([_blocks(_cut_bucket(cuts, buckets), cuts)])

    def gather(table: pa.Table) -> pa.Table:
        c = _rows(table, _CUT)
        c = c[np.lexsort((c["tie"], c["doc"]))]
        at = _groups(c["doc"], c["tie"])
        cuts = pa.ListArray.from_arrays(pa.array(np.append(at, len(c)).astype(np.int32)), pa.array(c["cut"]))
        return pa.table({"doc": pa.array(c["doc"][at]), "tie": pa.array(c["tie"][at]), "cuts": cuts})

    anchors = materialize(repeated_anchors(docs, buckets, hot), "repeated_anchors")
    wide = np.sort(np.array([(r.bucket << 32) | r.anchor for r in anchors.where("hot").toLocalIterator()], dtype=np.uint64))
    found = materialize(occurrences(docs, bitmap(anchors), wide, buckets), "occurrences")
    solved = materialize(found.where(F.col("bucket") < buckets).groupBy("bucket").applyInArrow(solve, _BLOCKS), "solved")
    cuts = found.where(F.col("bucket") >= buckets).withColumn("bucket", F.col("bucket") - buckets).unionByName(solved)
    return cuts.groupBy("bucket").applyInArrow(gather, "doc long, tie int, cuts array<long>")


WHOLE = -1  # the only cut of a document that goes whole


def _spans(n: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal covered runs among n bytes; a cut is
    start * 2**ROOM + mask."""
    if len(cuts) and cuts[0] == WHOLE:
        return np.array([0]), np.array([n])
    bits = np.arange(ROOM)
    at = ((cuts >> ROOM)[:, None] + bits)[(cuts[:, None] >> bits) & 1 == 1]
    depth = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + DEPTH, minlength=n + 1)) > 0
    edge = np.diff(np.concatenate([[False], depth[:n], [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _copies(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc, tie) of the documents whose whole text an earlier one has, and the bytes of all texts."""
    size = F.octet_length("text")
    names = materialize(docs.where(size >= DEPTH).select("doc", "tie", F.unhex(F.md5("text")).alias("digest"), size.alias("size")), "texts")
    first = names.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = materialize(names.join(first, "digest").where("first < doc").select("doc", "tie").distinct(), "copies")
    return found, names.agg(F.sum("size")).first()[0] or 0


def _with_cuts(docs: DataFrame, rows: DataFrame, hot: int) -> DataFrame:
    copies, size = _copies(docs)
    if copies.count() <= BROADCAST_COPIES:  # more of them go through the pieces like other texts
        docs = docs.join(F.broadcast(copies), ["doc", "tie"], "left_anti")
    else:
        copies = copies.limit(0)
    cuts = covered_pieces(docs, min(MAX_BUCKETS, -(-size // BUCKET) or 1), hot)
    whole = copies.select("doc", "tie", F.array(F.lit(WHOLE).cast("long")).alias("cuts"))
    cuts = materialize(cuts, "cuts").unionByName(whole).select(F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), "cuts")
    # one way at every size: cuts grow with the corpus
    return rows.hint("merge").join(cuts, F.expr("doc = _doc and tie = _tie"), "left")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Per row: (key, n_bytes, n_removed, n_spans, kept_sha256, spans); spans
    lists the removed runs as (start, end) in bytes, ends exclusive."""
    kind = docs.schema[key].dataType.simpleString()
    rows = _documents(docs, key, text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, offsets = string_parts(b.column(1))
            out = []
            for doc, a, e, cuts in zip(b.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), b.column(2)):
                whole = data[a:e].tobytes()
                start, end = _spans(e - a, cuts.values.to_numpy()) if cuts.is_valid else (np.zeros(0, np.int64),) * 2
                kept, at = hashlib.sha256(), 0
                for s, t in zip(start.tolist(), end.tolist()):
                    kept.update(whole[at:s])
                    at = t
                kept.update(whole[at:])
                out.append((None if doc == LAST else doc, e - a, int((end - start).sum()), len(start), kept.hexdigest(),
                            [{"start": s, "end": t} for s, t in zip(start.tolist(), end.tolist())]))
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    sent = _with_cuts(rows, rows, hot).select("doc", "text", "cuts")
    out = sent.mapInArrow(judge, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    return out.select(F.col("doc").cast(kind).alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``docs`` without the removed bytes; a character that loses some of its
    bytes goes as a whole.  Null texts stay null."""
    # the columns of docs travel as one value, so that no name can clash
    rows = docs.select(F.struct("*").alias("row"), *_name(key, F.col(text)))

    @F.pandas_udf("string")
    def cut(texts, cuts):
        def one(t, c):
            if t is None or c is None or not len(c):
                return t
            whole, at, kept = t.encode(), 0, b""
            for s, e in zip(*(x.tolist() for x in _spans(len(whole), c))):
                kept, at = kept + whole[at:s], e
            return (kept + whole[at:]).decode("utf-8", "ignore")
        return texts.combine(cuts, one)

    joined = _with_cuts(_documents(docs, key, text), rows, hot)
    return joined.select(F.col("row").withField(text, cut(F.col("row")[text], F.col("cuts"))).alias("row")).select("row.*")
