"""Chat formatting with compiled templates, and reading the formatted text back.

Turns of a conversation stream through a task in order; neither a conversation nor its output is ever held whole, as output leaves in
chunks. Control strings inside texts get a backslash after their first character (and backslashes are doubled), so that a
reader finds turns by their marks alone and restores every text exactly.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .template import compile_template

#: Marks of turns; opening mark of each kind with the closing one.
TURNS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
CONTROLS = [m for pair in TURNS.values() for m in pair] + [ROLE, TEXT, END]
TEMPLATE = """
{%- for m in messages -%}
  {%- if m.role == 'system' -%} <<SYS>>{{ m.text | guard }}<</SYS>>
  {%- elif m.role == 'user' -%} [INST]{{ m.text | guard }}[/INST]
  {%- elif m.role == 'assistant' -%} <s>{% generation %}{{ m.text | guard }}{% endgeneration %}</s>
  {%- else -%} <|role|>{{ m.role | guard }}<|text|>{{ m.text | guard }}<|end|>
  {%- endif -%}
{%- endfor -%}
"""
_STARTS = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)
_MARK = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_PAIR = re.compile(r"\\(.)", re.S)
CHUNK = 1 << 16


def guard(text) -> str:
    """text with its control strings broken, reversibly."""
    text = str(text).replace("\\", "\\\\")
    return _STARTS.sub(r"\1" + r"\\", text) if "<" in text or "[" in text else text


def unguard(text: str) -> str:
    return _PAIR.sub(r"\1", text) if "\\" in text else text


def chunks(pieces: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Chunks of the rendered text, each with the spans of it that are under the loss mask. Empty texts leave no span."""
    held, spans, size = [], [], 0
    for text, trained in pieces:
        if trained and text:
            if spans and spans[-1][1] == size:
                spans[-1] = (spans[-1][0], size + len(text))
            else:
                spans.append((size, size + len(text)))
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield "".join(held), spans
            held, spans, size = [], [], 0
    yield "".join(held), spans


class Reader:
    """Takes chunks of a formatted conversation and digests its turns and its masked text."""

    def __init__(self):
        self.rest, self.role, self.named, self.n, self.length = "", None, None, 0, 0
        self.turns, self.loss, self.loss_chars, self.half = hashlib.sha256(), hashlib.sha256(), 0, ""

    def feed(self, text: str, spans: list[dict]) -> None:
        self.length += len(text)
        for s in spans:
            part = self.half + text[s["start"]:s["end"]]
            odd = (len(part) - len(part.rstrip("\\"))) % 2
            self.half = part[-1:] if odd else ""
            plain = unguard(part[:-1] if odd else part)
            self.loss.update(plain.encode())
            self.loss_chars += len(plain)
        self.rest += text
        at = 0
        while m := _MARK.search(self.rest, at):
            self._mark(m[0], self.rest[at:m.start()])
            at = m.end()
        self.rest = self.rest[at:]

    def _mark(self, mark: str, before: str) -> None:
        for role, (start, end) in TURNS.items():
            if mark == start:
                self.role = role
            elif mark == end:
                self._turn(role, before)
        if mark == TEXT:
            self.named = unguard(before)
        elif mark == END:
            self._turn(self.named, before)

    def _turn(self, role: str, text: str) -> None:
        self.n += 1
        self.turns.update(f"{role}\n{unguard(text)}\n".encode())


def format_conversations(df: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, chunk, formatted, loss): the rendered conversation in chunks of about 64k characters, in order, loss being the
    masked spans in code points from the chunk's start.

    Turns go by turn, then role, then text; null turns first. A null role or text is empty; rows with a null conv_id are one
    conversation; repeated rows are turns like any other; an empty text is an empty turn. Other columns are not looked at. A
    conversation is one sequence, so its turns stream through one task, holding a turn and a chunk at a time.
    """
    turns = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                      F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"guard": guard})
        rows = ((c, {"role": r, "text": t}) for b in batches for c, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
        out, size = [], 0
        for conv, turns_ in groupby(rows, key=lambda x: x[0]):
            for number, (text, spans) in enumerate(chunks(render({"messages": (m for _, m in turns_)}))):
                out.append((conv, number, text, [{"start": a, "end": b} for a, b in spans]))
                size += len(text)
                if size > 1 << 22:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, chunk int, formatted string, loss array<struct<start: long, end: long>>")


def _batch(rows: list) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int32(), pa.string(), span]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "chunk", "formatted", "loss"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its chunks alone: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars). formatted: as format_conversations gives it, a conversation's chunks together and in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for conv, parts in groupby(rows, key=lambda r: r["conv_id"]):
            reader = Reader()
            for p in parts:
                reader.feed(p["formatted"], p["loss"])
            yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([reader.n]), pa.array([reader.turns.hexdigest()]), pa.array([reader.loss_chars]),
                                   pa.array([reader.loss.hexdigest()]), pa.array([reader.length])],
                                  ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
