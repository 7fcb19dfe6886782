"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trained on. A
conversation whose last turn is not an assistant's also gives one example without a target, so that the output holds
every turn and can be read back.

Template of a turn: ``<|im_start|>{role}\\n{text}<|im_end|>\\n``. Inside texts and roles ``<`` followed by any backslashes
and ``|`` gets one backslash more, so no control string can appear; reading back takes one away. In roles ``%`` and line
ends are percent-encoded too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, worker

START, END = "<|im_start|>", "<|im_end|>\n"
_GUARD, _GUARDED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _GUARD.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _GUARDED.sub(r"<\1|", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's string, and where its text starts and ends in it."""
    name = escape(role.replace("%", "%25").replace("\n", "%0A"))
    body = escape(text)
    head = f"{START}{name}\n"
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r).replace("%0A", "\n").replace("%25", "%"), unescape(t)) for r, t in _TURN.findall(formatted)]


def as_batch(rows: list[tuple], first: pa.DataType, names: list[str]) -> pa.RecordBatch:
    """Rows whose first column has the given type and whose others are typed by their values."""
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], first), *map(pa.array, columns[1:])], names)


EXAMPLE = "conv_id {id}, example long, formatted string, loss_start long, loss_end long, whole boolean"


def expand(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, example, formatted, loss_start, loss_end, whole.

    loss_start and loss_end are code points in formatted; both are 0 in an example without a target. whole: the example
    holds all turns of its conversation. Turns are ordered by turn (null first), equal ones by role and text; equal rows are
    turns each. Null text and role are empty. A null conv_id is a conversation. Rows are read in a stream sorted by
    conversation, so a task holds one conversation's context and never a group of them.
    """
    ship(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    t = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    names = ["conv_id", "example", "formatted", "loss_start", "loss_end", "whole"]

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, context, length, n, pending = None, None, 0, 0, None

        def last() -> tuple:
            return (*pending, True) if pending else (conv, n, "".join(context), 0, 0, True)

        for b in batches:
            for key, role, text in zip(*[b.column(i).to_pylist() for i in (0, 2, 3)]):
                if context is None or key != conv:
                    if context:
                        yield last()
                    conv, context, length, n, pending = key, [], 0, 0, None
                if pending:
                    yield (*pending, False)
                    pending = None
                turn, start, end = format_turn(role, text)
                context.append(turn)
                if role == "assistant":
                    pending = (conv, n, "".join(context), length + start, length + end)
                    n += 1
                length += len(turn)
        if context:
            yield last()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None

        def typed(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal first
            for b in bs:
                first = b.schema.field(0).type
                yield b

        out, size = [], 0
        for x in examples(typed(batches)):
            out.append(x)
            size += len(x[2])
            if size > 4_000_000 or len(out) >= 2_000:
                yield as_batch(out, first, names)
                out, size = [], 0
        if out:
            yield as_batch(out, first, names)

    return t.mapInArrow(worker(run), EXAMPLE.format(id=kind))


DIGEST = "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def read_back(examples: DataFrame) -> DataFrame:
    """Examples -> one row for each conversation: digests of its turns and of its trained text, read from the output."""
    ship(examples.sparkSession)
    kind = examples.schema["conv_id"].dataType.simpleString()
    e = examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row, out, first = object(), None, [], None

        def closed(conv, r) -> tuple:
            return conv, r["n"], r["turns"], r["loss_chars"], r["loss"].hexdigest(), r["chars"], r["examples"]

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]

        for b in batches:
            first = b.schema.field(0).type
            for conv, _, text, start, end, whole in zip(*[c.to_pylist() for c in b.columns]):
                if row is None or conv != now:
                    if row:
                        out.append(closed(now, row))
                    now, row = conv, {"n": 0, "turns": None, "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "examples": 0}
                row["chars"] += len(text)
                row["examples"] += 1
                trained = unescape(text[start:end])
                row["loss_chars"] += len(trained)
                row["loss"].update(trained.encode("utf-8", "surrogatepass"))
                if whole:
                    turns = parse(text)
                    row["n"] = len(turns)
                    digest = hashlib.sha256()
                    for r, t in turns:
                        digest.update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
                    row["turns"] = digest.hexdigest()
            if len(out) >= 5_000:
                yield as_batch(out, first, names)
                out = []
        if row:
            out.append(closed(now, row))
        if out:
            yield as_batch(out, first, names)

    return e.mapInArrow(worker(run), DIGEST.format(id=kind))
