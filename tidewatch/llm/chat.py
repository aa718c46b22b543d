"""Chat formatting by incremental black-box rendering.

A template is any callable from a list of (role, text) turns to a string.
Successive turn prefixes are rendered; what one rendering adds to the one
before is that turn's span.  Rendering the same prefix with a mark in place
of the turn's text shows where the text stands in the span.  A template
whose rendering of a prefix is no longer found at the front of the next one
rewrites history: the conversation is flagged and only turns that stand
unchanged in the final rendering keep their span and their loss.

Turns are ordered by turn, role and text, nulls first; repeated rows are
turns of their own.  A null text or role is empty.  A null conversation id
is a conversation of its own.  An empty table gives an empty table.  Columns
besides the four are ignored.  A conversation is one formatted value, so its
turns meet in one task, and n turns are rendered 2n times.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
MARK = "mark"

# Control strings of common chat formats, without their first character.
_CONTROL_TAILS = ["|", "s>", "/s>", "<SYS>>", "</SYS>>", "INST]", "/INST]", "/AVAILABLE_TOOLS]", "AVAILABLE_TOOLS]", "start_of_turn>", "end_of_turn>", "bos>", "eos>"]
_TAILS = "|".join(map(re.escape, _CONTROL_TAILS))
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")


def escape(s: str) -> str:
    """Break every control string with one backslash more than it has, so
    that none is left and ``unescape`` gives the text back."""
    return _ESCAPE.sub(r"\1\2\\", s)


def unescape(s: str) -> str:
    return _UNESCAPE.sub(r"\1\2", s)


def escape_role(s: str) -> str:
    return escape(s.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s))


def tagged(turns: Sequence[Turn]) -> str:
    """The template of the library: every turn between control strings."""
    return "".join(f"{OPEN}{escape_role(role)}{MIDDLE}{escape(text)}{CLOSE}" for role, text in turns)


def parse_tagged(formatted: str) -> list[Turn]:
    """Turns read back from what ``tagged`` wrote."""
    out = []
    for block in formatted.split(OPEN)[1:]:
        role, text = block[: -len(CLOSE)].split(MIDDLE, 1)
        out.append((unescape_role(role), unescape(text)))
    return out


def locate(turns: Sequence[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int] | None], bool]:
    """(final rendering, per turn (start, end, text start, text end) or None,
    whether the template rewrote history)."""
    final, rewrites, spans, before = "", False, [], ""
    shown, mark = [], MARK
    while any(mark in part for turn in turns for part in turn):
        mark += MARK
    for role, text in turns:
        shown.append((role, text))
        now = template(shown)
        marked = template([*shown[:-1], (role, mark)])
        at = marked.find(mark, len(before))
        if not now.startswith(before) or at < 0 or not marked.startswith(now[:at]):
            rewrites |= not now.startswith(before)
            spans.append(None)
        else:
            tail = len(marked) - at - len(mark)
            end = len(now) - tail
            spans.append((len(before), len(now), at, end) if at <= end and now[end:] == marked[len(marked) - tail:] else None)
        before = now
    final = before
    if rewrites:  # a span holds only if the final rendering still begins with its prefix
        again = ""
        for i in range(len(turns)):
            again = template(list(turns[: i + 1]))
            if not final.startswith(again):
                spans[i] = None
    return final, spans, rewrites


SCHEMA = ("n_turns long, formatted string, rewrites_history boolean, "
          "spans array<struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>>")


def format_conversations(turns: DataFrame, template: Template = tagged, loss_roles: Sequence[str] = ("assistant",),
                         key: str = "conv_id") -> DataFrame:
    """One row per conversation: (key, n_turns, formatted, rewrites_history,
    spans).  Positions are code points of ``formatted``, end exclusive; a turn
    without a span has null positions and no loss."""
    whole = (turns.groupBy(F.col(key).alias("_key"))
             .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns")))
    kind = dict(turns.dtypes)[key]
    wanted = set(loss_roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            rows = []
            for conv in b.column("_turns").to_pylist():
                said = [(t["role"] or "", t["text"] or "") for t in conv]
                final, spans, rewrites = locate(said, template)
                rows.append({"n_turns": len(said), "formatted": final, "rewrites_history": rewrites,
                             "spans": [dict(zip(("start", "end", "text_start", "text_end"), s or (None,) * 4), role=r, loss=s is not None and r in wanted)
                                       for s, (r, _) in zip(spans, said)]})
            if schema is None:
                i = pa.int32()
                schema = pa.struct([("n_turns", pa.int64()), ("formatted", pa.string()), ("rewrites_history", pa.bool_()),
                                    ("spans", pa.list_(pa.struct([("role", pa.string()), ("start", i), ("end", i), ("text_start", i), ("text_end", i), ("loss", pa.bool_())])))])
            made = pa.array(rows, schema)
            yield pa.RecordBatch.from_arrays([b.column("_key"), *made.flatten()], names=[key, *(f.name for f in schema)])

    return whole.mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the formatted text says when it is read back (for ``tagged``):
    (key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    kind = dict(formatted.dtypes)[key]

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, turns, chars, loss_sha, size = [], [], [], [], []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("spans").to_pylist()):
                said = parse_tagged(text)
                loss = "".join(unescape(text[s["text_start"]:s["text_end"]]) for s in spans if s["loss"])
                n.append(len(said))
                turns.append(sha("".join(f"{r}\n{t}\n" for r, t in said)))
                chars.append(len(loss))
                loss_sha.append(sha(loss))
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(size, pa.int64())],
                                             names=[key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(key, "formatted", "spans").mapInArrow(
        run, f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
