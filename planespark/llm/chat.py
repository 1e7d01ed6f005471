"""Conversations to training text with a loss mask, by compiled templates, and back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planespark.llm.chat_template import compile_template

#: Strings that structure the output. In roles and texts each gets a backslash before it, and so does each backslash.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = "{% for message in messages %}<s>[INST]{{ message.role | guard }}[/INST]{% if message.role == 'assistant' %}{% generation %}{{ message.text | guard }}{% endgeneration %}{% else %}{{ message.text | guard }}{% endif %}</s>\n{% endfor %}"
#: Characters of formatted text in one row, about; a longer conversation takes several.
PART_CHARS = 1 << 18

_OPEN = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_MARK = re.compile(r"\\(?:" + "|".join(map(re.escape, ("\\", *CONTROL))) + ")|" + "|".join(map(re.escape, CONTROL)))
_GUARDED = re.compile(r"\\(" + "|".join(map(re.escape, ("\\", *CONTROL))) + ")")

PARTS = "conv_id long, part long, formatted string, spans array<struct<first:int,last:int>>"
TURNS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def guard(text: str | None) -> str:
    return _OPEN.sub(lambda m: "\\" + m[0], text or "")


def unguard(text: str) -> str:
    return _GUARDED.sub(r"\1", text)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            yield from batch.slice(k, 256).to_pylist()


class _Grouped:
    """Runs of rows with one conv_id, each an iterator; rows are read only as they are asked for."""

    def __init__(self, rows: Iterator[dict]):
        self.rows = rows
        self.ahead = next(rows, None)

    def __iter__(self) -> Iterator[tuple[int | None, Iterator[dict]]]:
        while self.ahead is not None:
            key = self.ahead["conv_id"]
            yield key, self._run(key)

    def _run(self, key: int | None) -> Iterator[dict]:
        while self.ahead is not None and self.ahead["conv_id"] == key:
            row, self.ahead = self.ahead, next(self.rows, None)
            yield row


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Formatted text of each conversation, in parts, with the spans of generated text (character offsets in the part).

    Turns come in the order of turn, role and text; rows that tie in all are
    all kept. Null roles and texts are empty; a null conv_id is a conversation
    of its own. A task streams through its conversations turn by turn, so one
    of any length needs the memory of one part.
    """
    source = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"guard": guard})
        rows: list[tuple] = []
        held = 0
        for key, messages in _Grouped(_rows(batches)):
            part, texts, spans, size = 0, [], [], 0
            for text, generated in render(messages):
                if size >= PART_CHARS and not generated:
                    rows.append((key, part, "".join(texts), spans))
                    part, texts, spans, size = part + 1, [], [], 0
                if generated:
                    spans.append((size, size + len(text)))
                texts.append(text)
                size += len(text)
            rows.append((key, part, "".join(texts), spans))
            held += size + part * PART_CHARS
            if held >= 1 << 22:
                yield _parts(rows)
                rows, held = [], 0
        if rows:
            yield _parts(rows)

    return ordered.mapInArrow(run, PARTS)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    spans = pa.array([[{"first": a, "last": b} for a, b in x[3]] for x in rows], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.string()), spans], names=["conv_id", "part", "formatted", "spans"])


class TurnReader:
    """Finds the turns in the default template's output, given piece by piece."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.rest += text
        at, marks, place = 0, [], 0
        for m in _MARK.finditer(self.rest):
            if m[0][0] == "\\":
                continue
            marks.append((m[0], m.start(), m.end()))
            if m[0] == "</s>" and len(self.rest) > m.end():
                names = [x[0] for x in marks]
                if names != ["<s>", "[INST]", "[/INST]", "</s>"] or marks[0][1] != at or marks[0][2] != marks[1][1] or self.rest[m.end()] != "\n":
                    raise ValueError("the text is not a sequence of turns")
                yield unguard(self.rest[marks[1][2] : marks[2][1]]), unguard(self.rest[marks[2][2] : marks[3][1]])
                at, marks = m.end() + 1, []
                place = at
        self.rest = self.rest[place:]


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text alone: number and digest of turns, and length and digest of the text under the mask."""
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for key, pieces in _Grouped(_rows(batches)):
            reader, turns, loss = TurnReader(), hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            for piece in pieces:
                text = piece["formatted"]
                chars += len(text)
                for role, said in reader.feed(text):
                    n_turns += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for span in piece["spans"]:
                    said = unguard(text[span["first"] : span["last"]])
                    loss_chars += len(said)
                    loss.update(said.encode())
            if reader.rest:
                raise ValueError("a conversation ends within a turn")
            rows.append((key, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(rows) >= 10_000:
                yield _turns(rows)
                rows = []
        if rows:
            yield _turns(rows)

    return ordered.mapInArrow(run, TURNS)


def _turns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in TURNS.split(", ")])
