"""Secret scans: keyword automaton, anchored patterns, embedded checksums.

An Aho-Corasick automaton finds the keywords of all kinds in one pass over a
text (ASCII letters in either case); a pattern is tried only where one of
its keywords begins, and a match may not begin inside the one before of the
same kind.  Long hexadecimal runs have no keyword: the bytes are mapped to
two classes and runs are searched as a fixed string of that class.  Kinds
with an embedded checksum (the last six characters are the CRC-32 of those
before, in base 62) are kept only where the checksum holds.

A null or empty text has no secrets.  Rows are independent: repeated rows
and ties need no rule, an empty table gives an empty table, other columns
are ignored.  Whole texts are scanned, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# The kinds in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
_KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
_PATTERNS = {
    "assign": re.compile(rb"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
}
_MIN_ASSIGNED, _MIN_ACCESS, _MIN_HEX = 6, 20, 24
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX_CLASS = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))


def checksum(body: bytes) -> bytes:
    """CRC-32 in six base-62 digits."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r:r + 1] + out
    return out


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in _KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_AUTOMATON = None


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, in code points, by start and kind."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _automaton()
    raw = text.encode("utf-8")
    found = []
    hits: dict[str, list[int]] = {}
    for last, (kind, n) in _AUTOMATON.iter(raw.lower().decode("latin-1")):  # one character per byte
        hits.setdefault(kind, []).append(last - n + 1)
    for kind, starts in hits.items():
        done = 0
        for at in sorted(starts):
            if at < done or not (m := _PATTERNS[kind].match(raw, at)):
                continue
            done = m.end()
            if (kind == "assign" and m.end(1) - m.start(1) < _MIN_ASSIGNED or kind == "access" and len(m[0]) < _MIN_ACCESS
                    or kind in ("github", "npm") and checksum(m[0].split(b"_", 1)[1][:30]) != m[0][-6:]):
                continue
            found.append((at, m.end(), kind))
    classes = raw.translate(_HEX_CLASS)
    at = classes.find(b"\x01" * _MIN_HEX)
    while at >= 0:
        end = classes.find(b"\x00", at)
        end = len(raw) if end < 0 else end
        found.append((at, end, "hex"))
        at = classes.find(b"\x01" * _MIN_HEX, end)
    if not text.isascii():  # bytes to code points, walking forward once
        places = sorted({p for s in found for p in s[:2]})
        chars, at, n = {}, 0, 0
        for p in places:
            n += len(raw[at:p].decode("utf-8"))
            chars[p], at = n, p
        found = [(chars[a], chars[b], k) for a, b, k in found]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: (key, spans array<struct<kind,start,end,value>>)."""
    kind = dict(docs.dtypes)[key]
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(text):
                t = t.as_py() or ""
                rows.append([{"kind": k, "start": a, "end": e, "value": t[a:e]} for a, e, k in scan(t)])
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(rows, spans)], names=[key, "spans"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind:string,start:int,end:int,value:string>>")


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of scanned rows."""
    kind = dict(scanned.dtypes)[key]
    base = KINDS[:3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[(s["start"], s["end"], s["kind"]) for s in row] for row in b.column("spans").to_pylist()]
            counts = [pa.array([sum(s[2] == k for s in row) for row in rows], pa.int64()) for k in base]
            sha = [hashlib.sha256(_listed([s for s in row if s[2] in base]).encode()).hexdigest() for row in rows]
            yield pa.RecordBatch.from_arrays([b.column(key), *counts, pa.array(sha, pa.string()), pa.array(map(_listed, rows), pa.string())],
                                             names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scanned.mapInArrow(run, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
