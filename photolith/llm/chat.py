"""Chat formatting with a grammar round trip.

A turn is rendered as `[INST] role \\n text [/INST]`, a conversation ends with `</s>`. A rendered turn is read back at
once by a deterministic parser; while what it reads differs from the source, the turn's conflicting
content is escaped and the turn rendered again. Escaping puts one backslash into every control string (and into
every string that already has backslashes there), reading takes one out, so any text survives.

Turns are sorted within the partition of their conversation and stream through in that order: nothing is kept but a
part of bounded size, so a conversation may have any number of turns. A conversation comes out as one row, or, beyond
`PART_CHARS` characters, as several numbered parts.

Defined cases: null text or role: empty; turns with equal numbers are ordered by role, then text (nulls first);
repeated rows are turns of their own; a null conv_id is a conversation of its own; a null turn number comes first;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolith.llm._bytes import bound_batches, with_own_id

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
LEARNED = "assistant"
PART_CHARS = 1 << 22

_INST = re.compile(r"(\[/?)(\\*INST\])")
_EOS = re.compile(r"(</?)(\\*s>)")
_INST_BACK = re.compile(r"(\[/?)\\(\\*INST\])")
_EOS_BACK = re.compile(r"(</?)\\(\\*s>)")
_BARE = re.compile(r"\[/?INST\]|</?s>")

FORMATTED = "conv_id long, part long, text string, loss array<struct<start:long,stop:long>>, n_turns long, last boolean"
RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class ParseError(ValueError):
    """Text that isn't of the grammar."""


def escape(text: str) -> str:
    return _EOS.sub(r"\1\\\2", _INST.sub(r"\1\\\2", text))


def unescape(text: str) -> str:
    return _EOS_BACK.sub(r"\1\2", _INST_BACK.sub(r"\1\2", text))


def _role_out(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def parse(text: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """Role and text of each turn, and where the text as rendered starts and stops."""
    while at < len(text):
        if text.startswith(END, at):
            at += len(END)
            continue
        if not text.startswith(OPEN, at):
            raise ParseError(at)
        line = text.find("\n", at)
        stop = text.find(CLOSE, line + 1)
        if line < 0 or stop < 0:
            raise ParseError(at)
        role, body = text[at + len(OPEN) : line], text[line + 1 : stop]
        if _BARE.search(role) or _BARE.search(body):
            raise ParseError(at)
        yield _role_in(unescape(role)), unescape(body), line + 1, stop
        at = stop + len(CLOSE)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn that reads back as it is, and where its text starts and stops."""
    shown_role, shown = _role_out(role), text
    while True:
        out = f"{OPEN}{shown_role}\n{shown}{CLOSE}"
        try:
            read = list(parse(out))
        except ParseError:
            read = []
        if len(read) == 1 and read[0][:2] == (role, text):
            return out, read[0][2], read[0][3]
        # Of role and text, escape what doesn't read back on its own.
        if shown_role == _role_out(role) and (_BARE.search(shown_role) or _role_in(unescape(shown_role)) != role):
            shown_role = escape(shown_role)
        elif shown == text:
            shown = escape(text)
        else:
            raise ParseError(out)


def _ordered(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    bound_batches(df)
    rows = df.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """Rendered conversations, in numbered parts, with the spans of each part that are learned from."""

    def run(batches):
        now, part, size, pieces, loss, turns, open_ = None, 0, 0, [], [], 0, False
        out: list[tuple] = []
        kind = pa.int64()

        def flush(last: bool) -> None:
            nonlocal part, size, pieces, loss, turns
            out.append((now, part, "".join(pieces) + (END if last else ""), loss, turns, last))
            part, size, pieces, loss, turns = part + 1, 0, [], [], 0

        def batch():
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], type=kind), pa.array(cols[1], type=pa.int64()), pa.array(cols[2]), pa.array(cols[3], type=pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(cols[4], type=pa.int64()), pa.array(cols[5])],
                names=["conv_id", "part", "text", "loss", "n_turns", "last"],
            )

        waiting = 0
        for rows in batches:
            kind = rows.schema.field(0).type
            for conv, role, text in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                if open_ and conv != now:
                    flush(True)
                    part = 0
                now, open_ = conv, True
                shown, start, stop = render(role or "", text or "")
                if role == LEARNED:
                    loss.append({"start": size + start, "stop": size + stop})
                pieces.append(shown)
                size += len(shown)
                turns += 1
                waiting += len(shown)
                if size >= part_chars:
                    flush(False)
                if waiting >= part_chars and out:
                    yield batch()
                    waiting = 0
        if open_:
            flush(True)
        if out:
            yield batch()

    rows = _ordered(df, conv_col, turn_col, role_col, text_col)
    return rows.mapInArrow(run, with_own_id(FORMATTED, rows, "conv_id"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted conversations read back as; parts must be in the order in which `format_conversations` makes them."""

    def run(batches):
        out: list[tuple] = []
        state = None
        for rows in batches:
            for conv, text, loss, last in zip(*(rows.column(i).to_pylist() for i in (0, 2, 3, 5)), strict=True):
                state = state or [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body, _, _ in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    body = unescape(text[span["start"] : span["stop"]])
                    state[2] += len(body)
                    state[3].update(body.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                if last:
                    out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    state = None
            if out:
                cols = list(zip(*out, strict=True))
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string() if i in (2, 4) else pa.int64() if i else rows.schema.field(0).type) for i, c in enumerate(cols)], names=[x.split()[0] for x in RESULT.split(", ")])

    return formatted.mapInArrow(run, with_own_id(RESULT, formatted, "conv_id"))
