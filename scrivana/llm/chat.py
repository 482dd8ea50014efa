r"""Chat formatting with typed content parts.

A turn's content is a list of parts, each of a type: text, image, audio or document. A visitor flattens them in
order: texts are escaped, every other part becomes one placeholder, and its reference and expanded token count
are recorded. Every turn is formatted by itself, so the size of a conversation doesn't matter; a conversation is
its turns in order.

    user       [INST]text[/INST]        system     [SYS]text[/SYS]
    assistant  [ANS]text</s>            any other  [ROLE]name[:]text[/ROLE]
    parts      [IMAGE:k] [AUDIO:k] [DOCUMENT:k], k counting the turn's attachments from 0

A control string inside a text or a role name gets one more backslash after its first character ("[\INST]"), and
reading takes one away, so any text comes back as it was. The loss mask covers the texts of assistant turns.

Null texts are empty, a null role is the empty name, a null turn comes first; turns with the same number are
ordered by role, then by their formatted text, and repeated rows are turns of their own; a null conv_id is a
conversation; an empty table gives none; other columns don't matter, nor does one named parts that holds no parts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import Scratch

MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[:]", "[/ROLE]")
CONTROL = r"/?INST\]|ANS\]|/?SYS\]|/?ROLE\]|:\]|/?s>|(?:IMAGE|AUDIO|DOCUMENT):[0-9]+\]"
ESCAPE = re.compile(rf"([\[<])(\\*)({CONTROL})")
UNESCAPE = re.compile(rf"([\[<])\\(\\*)({CONTROL})")
REAL = re.compile(rf"[\[<](?:{CONTROL})")
PLACEHOLDER = re.compile(r"\[(IMAGE|AUDIO|DOCUMENT):([0-9]+)\]")

#: Tokens that a part of unknown size stands for.
EXPANDED = {"image": 256, "audio": 128, "document": 512}


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


@dataclass
class Flattener:
    """Visits the parts of one turn."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        handler = getattr(self, f"visit_{kind}", None)
        if handler is None:
            raise ValueError(f"unknown part type {kind!r}")
        handler(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)

    def _attach(self, kind: str, part: dict) -> None:
        k = len(self.attachments)
        n = part.get("tokens")
        self.pieces.append(f"[{kind.upper()}:{k}]")
        self.attachments.append({"position": k, "type": kind, "reference": part.get("reference"), "tokens": EXPANDED[kind] if n is None else int(n)})


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """The formatted turn, the span under the loss mask (empty if none), and its attachments."""
    seen = Flattener()
    for part in parts:
        seen.visit(part)
    # a control string must not arise where two parts meet
    content = "".join(seen.pieces)
    if len(seen.pieces) > 1 and len(REAL.findall(content)) != len(seen.attachments):
        raise ValueError("adjacent text parts make a control string; join them first")
    role = role or ""
    if role in MARKS:
        begin, end = MARKS[role]
    else:
        begin, end = f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2]
    start = len(begin)
    return begin + content + end, start, start + (len(content) if role == "assistant" else 0), seen.attachments


def join_texts(parts: list[dict]) -> list[dict]:
    """Neighbouring text parts as one."""
    out: list[dict] = []
    for p in parts:
        if out and (p.get("type") or "text") == "text" == (out[-1].get("type") or "text"):
            out[-1] = {"type": "text", "text": (out[-1].get("text") or "") + (p.get("text") or "")}
        else:
            out.append(dict(p))
    return out


def read_turn(formatted: str) -> tuple[str, list[dict]]:
    """Role and parts of a formatted turn; a part that isn't text has the position of its attachment."""
    for role, (begin, end) in MARKS.items():
        if formatted.startswith(begin):
            content = formatted[len(begin) : len(formatted) - len(end)]
            break
    else:
        cut = formatted.index(OTHER[1], len(OTHER[0]))
        role = unescape(formatted[len(OTHER[0]) : cut])
        content, end = formatted[cut + len(OTHER[1]) : len(formatted) - len(OTHER[2])], OTHER[2]
    if not formatted.endswith(end):
        raise ValueError(f"no {end} at the end")
    parts, at = [], 0
    for m in PLACEHOLDER.finditer(content):
        if m.start() > at:
            parts.append({"type": "text", "text": unescape(content[at : m.start()])})
        parts.append({"type": m[1].lower(), "position": int(m[2])})
        at = m.end()
    if at < len(content) or not parts:
        parts.append({"type": "text", "text": unescape(content[at:])})
    return role, parts


FORMATTED = "conv_id long, turn long, role string, formatted string, loss_start int, loss_end int, attachments array<struct<position:int,type:string,reference:string,tokens:int>>"
ATTACHMENTS = pa.list_(pa.struct([("position", pa.int32()), ("type", pa.string()), ("reference", pa.string()), ("tokens", pa.int32())]))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row for each turn of (conv_id, turn, role, text, and parts where there is such a column)."""
    own = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")]
    if re.match(r"array<struct<.*\btype:string", dict(turns.dtypes).get("parts", "")):
        own.append(F.col("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            parts = batch.column(4).to_pylist() if batch.num_columns > 4 else [None] * len(texts)
            done = [format_turn(r, join_texts(p) if p else [{"type": "text", "text": t}]) for r, t, p in zip(roles, texts, parts)]
            ties = [r or "" for r in roles]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ties), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32()), pa.array([d[3] for d in done], ATTACHMENTS)], names=["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments"])

    return turns.select(*own).mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"


class Digest:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.attached = self.tokens = 0

    def add(self, formatted: str, start: int, end: int, attachments: list[dict]) -> None:
        role, parts = read_turn(formatted)
        text = "".join(p["text"] if p["type"] == "text" else f"[{p['type'].upper()}:{p['position']}]" for p in parts)
        self.turns.update(f"{role}\n{text}\n".encode())
        masked = unescape(formatted[start:end])
        self.loss.update(masked.encode())
        self.loss_chars += len(masked)
        self.chars += len(formatted)
        self.n += 1
        self.attached += len(attachments)
        self.tokens += sum(a["tokens"] for a in attachments)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.attached, self.tokens


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read from its formatted turns as they pass in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Digest | None = None
        for batch in batches:
            done = []
            for conv, text, start, end, attached in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "attachments"))):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Digest(conv)
                now.add(text, start, end, attached)
            if done:
                yield rows(done)
        if now is not None:
            yield rows([now.row()])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in DIGEST.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted").mapInArrow(run, DIGEST)


def chat_rows(spark: SparkSession, turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Formats all turns into a staged table and reads each conversation back from it."""
    scratch = scratch or Scratch(spark, "chat")
    return read_back(scratch.put("formatted", format_turns(turns)))
