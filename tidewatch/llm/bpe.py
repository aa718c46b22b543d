"""Byte-pair encoding and decoding with a vocabulary file of merge ranks.

The file is the JSON form of a byte-level BPE with word ends: texts are cut
at the special strings, normalised (NFC, lower case), split into letters,
single numerals, contractions and other signs, and each piece is merged by
rank.  A short piece looks for the lowest rank among its pairs after each merge;
a long one keeps a heap of (rank, position) over a doubly linked list of
symbols, where an entry whose symbols have changed since it was pushed is stale
and skipped.  Letters and numerals are those of the ``regex`` package's
Unicode tables, which may know code points that another version does not.
Decoding writes the vocabulary strings one after another,
separated as the file's decoder says (a space where it names none).

Nulls and empty texts have no tokens.  Rows are independent: repeated rows
and ties need no rule, an empty table gives an empty table, and other
columns are carried through untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CACHED_CHUNKS = 160_000  # chunks a worker remembers before it starts afresh
CACHED_PIECES = 200_000  # pieces likewise (about 200 bytes each)
SHORT = 40  # bytes up to which a piece is merged without a heap

# Control characters that str.split() takes as white space and the pattern's \s does not.
_SPLIT_DIFFERS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {}, 0
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Bpe(dict):
    """Encoder of one vocabulary.  As a dict it remembers the token ids
    (little-endian 32-bit) of white-space-free chunks of normalised text;
    ``known`` remembers those of the pieces that chunks are made of."""

    def __init__(self, spec: bytes):
        super().__init__()
        self.known: dict[str, bytes] = {}
        j = json.loads(spec)
        model = j["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        # the same merges as plain numbers, (left, right) -> (rank, new) in base ``base``
        self.base = max(self.vocab.values(), default=0) + 1
        self.steps = {a * self.base + b: rank * self.base + new for (a, b), (rank, new) in self.merges.items()}
        self.none = (len(model["merges"]) + 1) * self.base
        steps = j["normalizer"]["normalizers"] if j.get("normalizer") else []
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        self.nfc = any(s["type"] == "NFC" for s in steps)
        split = next(s for s in j["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.letters = byte_letters()
        self.joiner = " " if j.get("decoder") is None else ""

    def merge(self, piece: str) -> list[int]:
        """Token ids of one piece: lowest rank first, leftmost first among equals."""
        vocab, letters = self.vocab, self.letters
        raw = [letters[b] for b in piece.encode("utf-8")]
        raw[-1] += self.suffix
        sym = [vocab[c] for c in raw]
        if len(sym) > SHORT:
            return self._merge_long(sym)
        get, base, none = self.steps.get, self.base, self.none
        open_ = [get(a * base + b, none) for a, b in zip(sym, sym[1:])]
        while open_:
            best = min(open_)
            if best == none:
                break
            i = open_.index(best)
            sym[i] = new = best % base
            del sym[i + 1], open_[i]
            if i < len(open_):
                open_[i] = get(new * base + sym[i + 1], none)
            if i:
                open_[i - 1] = get(sym[i - 1] * base + new, none)
        return sym

    def _merge_long(self, sym: list[int]) -> list[int]:
        """The same by a heap: a long piece costs n log n."""
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            m = self.merges.get((sym[i], sym[i + 1]))
            if m:
                heap.append((m[0], i, m[1]))
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, new = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = right[i]
            if j < 0 or self.merges.get((sym[i], sym[j])) != (rank, new):
                continue  # stale: one of the two symbols has been merged since
            sym[i], alive[j], right[i] = new, False, right[j]
            if right[i] >= 0:
                left[right[i]] = i
                m = self.merges.get((new, sym[right[i]]))
                if m:
                    heapq.heappush(heap, (m[0], i, m[1]))
            if left[i] >= 0:
                m = self.merges.get((sym[left[i]], new))
                if m:
                    heapq.heappush(heap, (m[0], left[i], m[1]))
        return [s for s, a in zip(sym, alive) if a]

    def __missing__(self, chunk: str) -> bytes:
        out = []
        for piece in self.pieces.findall(chunk):
            ids = self.known.get(piece)
            if ids is None:
                ids = self.known[piece] = struct.pack(f"<{len(m := self.merge(piece))}I", *m)
            out.append(ids)
        self[chunk] = joined = b"".join(out)
        return joined

    def normal(self, s: str) -> str:
        if not s.isascii():
            if self.nfc:
                s = unicodedata.normalize("NFC", s)
            if self.lower:  # letter by letter: no rule for a sigma at a word's end
                s = s.replace("Σ", "σ")
        return s.lower() if self.lower else s

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if len(self) > CACHED_CHUNKS:
            self.clear()
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
                continue
            s = self.normal(part)
            chunks = self.pieces.findall(s) if _SPLIT_DIFFERS.search(s) else s.split()
            out.extend(map(self.__getitem__, chunks))
        return b"".join(out)

    def decode(self, ids: bytes | list[int]) -> str:
        """The ids' strings, special ones included."""
        ids = np.frombuffer(ids, dtype="<u4").tolist() if isinstance(ids, bytes) else ids
        return self.joiner.join(map(self.strings.__getitem__, ids))


_LOADED: dict[str, Bpe] = {}


def loaded(spec: bytes) -> Bpe:
    """One encoder per worker process and vocabulary."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(spec)
    return _LOADED[key]


def read_vocabulary(path: str) -> bytes:
    """The file as read on the driver; it travels to the workers as a broadcast
    (a vocabulary of a few MB, whatever the size of the corpus)."""
    with open(path, "rb") as f:
        return f.read()


def _columns(docs: DataFrame, new: list[str]) -> list[str]:
    return [c for c in docs.columns if c not in new]


def encode(docs: DataFrame, vocabulary: bytes, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) in place of a column of that name."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary)
    keep = _columns(docs, [ids])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):  # the ids of a whole batch would be held at once
                part = b.slice(at, 512)
                coded = [bpe.encode(t) for t in part.column(text).to_pylist()]
                off = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(coded), dtype="<i4"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(off), values)], names=[*keep, ids])

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, vocabulary: bytes, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``coded`` with the text of ``ids`` (null or empty: an empty text)."""
    spec = coded.sparkSession.sparkContext.broadcast(vocabulary)
    keep = _columns(coded, [text])
    schema = T.StructType([coded.schema[c] for c in keep] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for b in batches:
            out = [bpe.decode(x or []) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, text])

    return coded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text and decode its ids again within the same task, so that
    neither leaves it: (key, n_tokens, ids_sha256, decoded_sha256)."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(text):
                ids = bpe.encode(t.as_py())
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def encode_checked(docs: DataFrame, vocabulary: bytes, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with ``ids`` in place of ``text``, its length ``n_tokens`` and
    ``decoded_sha256``, the digest of the text that the ids decode to."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary)
    keep = _columns(docs, [text, ids, "n_tokens", "decoded_sha256"])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField(ids, T.ArrayType(T.IntegerType())),
                                                            T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                coded = [bpe.encode(t.as_py()) for t in part.column(text)]
                n = [len(c) // 4 for c in coded]
                sha = [hashlib.sha256(bpe.decode(c).encode("utf-8")).hexdigest() for c in coded]
                values = pa.array(np.frombuffer(b"".join(coded), dtype="<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n, pa.int64()), lists, pa.array(sha, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)
