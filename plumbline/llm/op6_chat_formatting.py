"""Chat formatting: conversations rendered by a compiled template, with the spans that a model has to produce.

format_chats() deals turns out by conversation, sorts them and streams them through the template's closures. The
output has one row for each conversation, or several numbered parts where a conversation is longer than PART_CHARS:
the formatted text and the spans (start, end, in characters of the part) under the loss mask. Parts are cut between
two emissions of the template, so that no message is split. A task holds one part and one message at a time, whatever
the length of a conversation.

Control strings inside texts and roles are escaped reversibly, so read_chats() can tell the turns apart again.

Cases: a null text or role is empty; a null conv_id is a conversation of its own; null turns come first; turns with
equal numbers are ordered by role and text, and repeated rows are repeated turns; roles other than user and assistant
are named in the output; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, scratch_path, sliced, table
from .templates import Escaper, compile_template

TEMPLATE = """{% for m in messages %}{% if m.role == 'user' %}{{ '<s>' ~ '[INST] ' }}{{ m.text }} [/INST]{% elif m.role == 'assistant' %}{% generation %}{{ m.text }}{% endgeneration %}</s>{% else %}<s>[ROLE]{{ m.role }}[/ROLE]{{ m.text }}</s>{% endif %}{% endfor %}"""
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
#: A conversation's part is closed once it has so many characters.
PART_CHARS = 1 << 20
#: Characters that are handed on together.
BATCH_CHARS = 4 << 20

_FILE = "conv_id long, part long, last boolean, text string, spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in sliced(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _parts(segments: Iterator[tuple[str, bool]], limit: int) -> Iterator[tuple[str, list[dict]]]:
    """Join segments to parts with their spans."""
    texts: list[str] = []
    spans: list[dict] = []
    size = 0
    for text, marked in segments:
        if size >= limit:
            yield "".join(texts), spans
            texts, spans, size = [], [], 0
        if marked and text:
            if spans and spans[-1]["end"] == size:
                spans[-1]["end"] += len(text)
            else:
                spans.append({"start": size, "end": size + len(text)})
        texts.append(text)
        size += len(text)
    yield "".join(texts), spans


def format_chats(turns: DataFrame, path: str, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, part_chars: int = PART_CHARS) -> str:
    """Render turns (conv_id, turn, role, text) and write them to path; returns path."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = compile_template(template, controls)
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.string(), _SPANS), strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "last", "text", "spans"])

        for conv, own in groupby(_rows(batches), key=lambda r: r[0]):
            messages = ({"role": role or "", "text": text or ""} for _, role, text in own)
            waiting = None
            for k, (text, spans) in enumerate(_parts(program(messages), part_chars)):
                if waiting:
                    held.append(waiting)
                waiting = (conv, k, False, text, spans)
                size += len(text)
                if size >= BATCH_CHARS and held:
                    yield out()
                    held, size = [], len(text)
            held.append((*waiting[:2], True, *waiting[3:]))
        if held:
            yield out()

    dealt = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    arrow_map(dealt.select("conv_id", "role", "text"), render, _FILE).write.option("compression", "zstd").parquet(path)
    return path


class _Turns:
    """Reads the turns of one conversation from its parts, one after the other."""

    def __init__(self, escaper: Escaper):
        self.escaper, self.rest = escaper, ""

    def feed(self, text: str, last: bool) -> Iterator[tuple[str, str]]:
        self.rest += text
        at = 0
        while at < len(self.rest):
            turn = self._turn(at, last)
            if turn is None:
                break
            role, own, at = turn
            yield self.escaper.unescape(role), self.escaper.unescape(own)
        self.rest = self.rest[at:]
        if last and self.rest:
            raise ValueError(f"not a formatted conversation: {self.rest[:40]!r}")

    def _turn(self, at: int, last: bool) -> tuple[str, str, int] | None:
        text = self.rest
        if not last and len(text) - at < len("<s>[INST] "):
            return None
        if text.startswith("<s>[INST] ", at):
            start, role, close = at + len("<s>[INST] "), "user", " [/INST]"
        elif text.startswith("<s>[ROLE]", at):
            stop = text.find("[/ROLE]", at)
            if stop < 0:
                return None
            start, role, close = stop + len("[/ROLE]"), text[at + len("<s>[ROLE]") : stop], "</s>"
        else:
            start, role, close = at, "assistant", "</s>"
        end = text.find(close, start)
        return None if end < 0 else (role, text[start:end], end + len(close))


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """The formatted parts: conv_id, part, last, text, spans."""
    return spark.read.schema(_FILE).parquet(path)


def digest(parts: DataFrame, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """What the formatted rows hold, for each conversation: its turns, the text under the loss mask, its size."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper, held = Escaper(controls), []

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], [c.split()[0] for c in _DIGEST.split(", ")])

        for conv, own in groupby(_rows(batches), key=lambda r: r[0]):
            turns, loss, parser = hashlib.sha256(), hashlib.sha256(), _Turns(escaper)
            n = loss_chars = chars = 0
            for _, _, last, text, spans in own:
                chars += len(text)
                for role, said in parser.feed(text, last):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for s in spans:
                    said = escaper.unescape(text[s["start"] : s["end"]])
                    loss.update(said.encode())
                    loss_chars += len(said)
            held.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(held) >= 10_000:
                yield out()
                held.clear()
        if held:
            yield out()

    # a conversation in one part needs no other row; the few long ones are brought together and read in order
    whole = (F.col("part") == 0) & F.col("last")
    long = parts.filter(~whole).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return arrow_map(parts.filter(whole), summed, _DIGEST).union(arrow_map(long, summed, _DIGEST))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    further = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{control}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(further)
    return digest(read_chats(spark, format_chats(turns, scratch_path(spark, "chats"))))
