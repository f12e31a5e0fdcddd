"""Chat formatting with typed content parts.

A visitor flattens each turn's parts in order: text is escaped, images, audio and documents become placeholders whose
references, positions and expanded token counts are recorded. Turns are marked by control strings. Control strings inside texts
and roles are broken by a backslash, which is itself doubled, so the formatted text reads back exactly. Conversations are
formatted and read as streams of turns sorted within partitions, so a conversation of any length takes bounded memory.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
BEGIN, END = "<s>", "</s>"
USER, USER_END = "[INST]", "[/INST]"
SYSTEM, SYSTEM_END = "[SYS]", "[/SYS]"
ANSWER = "[ANS]"
OTHER, NAME_END, OTHER_END = "[TURN]", "[SEP]", "[/TURN]"
MEDIA, MEDIA_END = "<|media:", "|>"
CONTROLS = (BEGIN, END, USER, USER_END, SYSTEM, SYSTEM_END, ANSWER, OTHER, NAME_END, OTHER_END, MEDIA)
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
#: Opening and closing control string by role; any other role is named inside [TURN].
ROLES = {"user": (USER, USER_END), "system": (SYSTEM, SYSTEM_END), "assistant": (ANSWER, END)}

PART = ("struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@dataclass
class PartVisitor:
    """Flattens parts; one method for each type. Token counts follow patches, seconds and pages."""

    patch: int = 14
    tokens_per_second: float = 25.0
    tokens_per_page: int = 256
    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str | None, int, int]] = field(default_factory=list)
    chars: int = 0

    def visit(self, part: dict) -> None:
        method = getattr(self, f"visit_{part.get('type') or 'text'}", None)
        if method is None:
            raise ValueError(f"unknown part type {part['type']!r}")
        method(part)

    def _add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.chars += len(piece)

    def visit_text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append((kind, part.get("ref"), self.chars, tokens))
        self._add(f"{MEDIA}{kind}:{len(self.attachments) - 1}{MEDIA_END}")

    def visit_image(self, part: dict) -> None:
        width, height = part.get("width") or 0, part.get("height") or 0
        self._attach("image", part, math.ceil(width / self.patch) * math.ceil(height / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.tokens_per_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.tokens_per_page)


def format_turn(role: str | None, parts: list[dict] | None) -> tuple[str, int, int, list[tuple[str, str | None, int, int]]]:
    """(piece, where its content starts and ends, attachments with their position in the piece)."""
    visitor = PartVisitor()
    for part in parts or []:
        visitor.visit(part)
    role = role or ""
    opening, closing = ROLES.get(role, (OTHER + escape(role) + NAME_END, OTHER_END))
    content = "".join(visitor.pieces)
    start = len(opening)
    return (opening + content + closing, start, start + len(content),
            [(kind, ref, start + at, tokens) for kind, ref, at, tokens in visitor.attachments])


_TURN = re.compile("|".join(map(re.escape, (BEGIN, USER, SYSTEM, ANSWER, OTHER))))


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start and end of the text) of each turn. Media placeholders stay in the text as they are."""
    at = 0
    roles = {opening: (role, closing) for role, (opening, closing) in ROLES.items()}
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no control string at {at}")
        at = m.end()
        if m[0] == BEGIN:
            continue
        if m[0] == OTHER:
            end = formatted.index(NAME_END, at)
            role, closing = unescape(formatted[at:end]), OTHER_END
            at = end + len(NAME_END)
        else:
            role, closing = roles[m[0]]
        end = formatted.index(closing, at)
        yield role, unescape(formatted[at:end]), at, end
        at = end + len(closing)


_PIECES = pa.schema([("conv_id", pa.int64()), ("first", pa.bool_()), ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()),
                     ("attachments", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])))])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before: object = _format  # equal to no id
    for batch in batches:
        out: list[tuple] = []
        for conv, role, parts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "parts")), strict=True):
            piece, start, end, attachments = format_turn(role, parts)
            first = before is _format or conv != before
            if first:
                piece, start, end = BEGIN + piece, start + len(BEGIN), end + len(BEGIN)
                attachments = [(k, r, at + len(BEGIN), n) for k, r, at, n in attachments]
            before = conv
            loss = role == "assistant"
            out.append((conv, first, piece, start if loss else None, end if loss else None,
                        [dict(zip(("type", "ref", "at", "tokens"), a, strict=True)) for a in attachments]))
        columns = zip(*out, strict=True) if out else ([] for _ in _PIECES)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)


def text_part(text: Column) -> Column:
    """A column of parts with one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"),
                            null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def format_conversations(turns: DataFrame, parts: Column | None = None) -> DataFrame:
    """(conv_id, first, piece, loss_start, loss_end, attachments) by turn, a conversation's turns together and in order.

    A conversation's formatted text is its pieces one after another; ``first`` opens it. Spans count characters of the piece.
    ``parts`` is an array of parts (see PART), by default the text column as one text part; null parts and texts are empty, a
    null role is an empty role. Rows that share a turn go by role, then text. Rows with a null conv_id form one conversation.
    Columns other than conv_id, turn, role and the parts are not read.
    """
    content = text_part(F.col("text")) if parts is None else parts
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                        content.cast(f"array<{PART}>").alias("parts"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.to_json("parts"))
    return ordered.select("conv_id", "role", "parts").mapInArrow(
        _format, "conv_id long, first boolean, piece string, loss_start long, loss_end long, attachments array<struct<type:string,ref:string,at:long,tokens:long>>")


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                   ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    state: list | None = None

    def finish() -> None:
        if state:
            conv, n, turns, chars, loss, length = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length))

    def drained() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * len(_READ)
        out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _READ, strict=True)], schema=_READ)
        done.clear()
        return out

    for batch in batches:
        for conv, first, piece, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "first", "piece", "loss_start", "loss_end")), strict=True):
            if first:
                finish()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, at, to in read_turns(piece):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start is not None and (at, to) == (start, end):
                    state[3] += len(text)
                    state[4].update(text.encode("utf-8", "surrogatepass"))
            state[5] += len(piece)
        yield drained()
    finish()
    yield drained()


def read_conversations(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, from the output of format_conversations alone: number of turns, digest of roles and
    texts, length and digest of the text under the loss mask, length of the formatted text."""
    return formatted.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
