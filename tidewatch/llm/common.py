"""Text batches as flat arrays: words, hashes and shingles of many texts at once.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``.
These are ASCII, so splitting the UTF-8 bytes splits the text.  Hashes are
64-bit; equality of hashes stands for equality of words or shingles (two
sets of n and m shingles meet a false match with probability n*m / 2**64).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SHINGLE_WORDS = 5
_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _C2
    x = (x ^ (x >> _U(27))) * _C3
    return x ^ (x >> _U(31))


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8)[off[0]:off[-1]] if buf is not None and len(col) else np.zeros(0, np.uint8)
    return data, off - off[0] if len(col) else np.zeros(1, np.int64)


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a piece holds about ``max_bytes`` of text
    (a single longer text is a piece of its own)."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = string_parts(b.column(b.schema.get_field_index(text)))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1)
            yield b.slice(at, end - at)
            at = end


class Words:
    """Words of the texts of one Arrow string column.

    ``starts``/``ends`` are byte positions in ``data``, ``bounds[i]:bounds[i+1]``
    the words of part i, where the parts are the texts themselves or, with
    ``cuts``, finer pieces of the byte range (for example lines).
    ``word_bytes`` marks the bytes of words, where they are not those above.
    """

    def __init__(self, col: pa.Array, lower: bool = False, cuts: np.ndarray | None = None, word_bytes: np.ndarray | None = None):
        self.data, self.offsets = string_parts(col)
        if lower:
            self.data = _LOWER[self.data]
        cuts = self.offsets if cuts is None else cuts
        word = ~_SPACE[self.data] if word_bytes is None else word_bytes[self.data]
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[cuts] = True
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.is_word_byte = word
        self.bounds = np.searchsorted(self.starts, cuts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """One 64-bit hash per word, read eight bytes at a time."""
        length = self.ends - self.starts
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))
        h = mix(length.astype(np.uint64) * _C1 + _C3 + _U(seed))
        at, left, active = self.starts, length, None
        while len(at):
            v = eight[at] & _MASKS[np.minimum(left, 8)]
            if active is None:
                h = mix((h ^ v) * _C1)
            else:
                h[active] = mix((h[active] ^ v) * _C1)
            more = np.flatnonzero(left > 8)
            active = more if active is None else active[more]
            at, left = at[more] + 8, left[more] - 8
        return h

    def shingles(self, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds): the k-word windows of each part in order; a part
        of 1 to k-1 words has its whole word sequence as its only one."""
        h = self.hashes()
        n = np.diff(self.bounds)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        bounds = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(bounds[-1], dtype=np.uint64)
        if len(h) >= k:
            acc = mix(h[:len(h) - k + 1] + _C1)
            for j in range(1, k):
                acc = mix(acc * _C1 + h[j:len(h) - k + 1 + j])
            long = np.flatnonzero(n >= k)
            take = np.zeros(len(acc) + 1, dtype=np.int64)
            np.add.at(take, self.bounds[:-1][long], 1)
            np.add.at(take, self.bounds[:-1][long] + count[long], -1)
            inside = np.cumsum(take[:-1]) > 0
            place = np.zeros(len(out) + 1, dtype=np.int64)
            np.add.at(place, bounds[:-1][long], 1)
            np.add.at(place, bounds[:-1][long] + count[long], -1)
            out[np.cumsum(place[:-1]) > 0] = acc[inside]
        for i in np.flatnonzero((n > 0) & (n < k)):
            acc = mix(mix(n[i:i + 1].astype(np.uint64)) + h[self.bounds[i]:self.bounds[i] + 1])
            for j in range(self.bounds[i] + 1, self.bounds[i + 1]):
                acc = mix(acc * _C1 + h[j:j + 1])
            out[bounds[i]] = acc[0]
        return out, bounds


def part_sets(shingles: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct shingles of each part, ascending."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a < 2:
            yield shingles[a:b]
            continue
        s = np.sort(shingles[a:b])
        keep = np.empty(len(s), dtype=bool)
        keep[0] = True
        np.not_equal(s[1:], s[:-1], out=keep[1:])
        yield s[keep]


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
