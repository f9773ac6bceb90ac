"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example holds all preceding turns as context and one assistant turn as target; only the target's text is trainable
(loss_start, loss_end, code points in the formatted text). Turns after the last assistant turn form a closing example
without a target, so the output holds every turn. Control strings inside texts and roles are escaped reversibly.

Defined results: turns are ordered by turn, then role, then text, nulls first; a null role or text is empty; rows with a
null conv_id form one conversation; repeated rows are turns of their own; an empty table gives no rows; other columns
are ignored. A conversation streams through one task that holds the text of that conversation only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanspark.llm.common import bound_batches

START, END = "<|im_start|>", "<|im_end|>"
EXAMPLES = "conv_id bigint, example bigint, n_context bigint, formatted string, loss_start bigint, loss_end bigint"
BATCH_CHARS = 8_000_000
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left: a backslash is doubled and one goes between the characters of "<|"."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(role: str, text: str) -> tuple[str, str, str]:
    """What stands before a turn's text, the text, and what stands after it."""
    return f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example."""
    return [(unescape_role(r), unescape(t)) for r, t in TURN.findall(formatted)]


class Expansion:
    """Examples of one conversation, turn by turn."""

    def __init__(self, conv):
        self.conv, self.parts, self.chars, self.turns, self.examples, self.open = conv, [], 0, 0, 0, False

    def add(self, role: str, text: str) -> tuple | None:
        head, body, tail = render(role, text)
        start = self.chars + len(head)
        self.parts.append(head + body + tail)
        self.chars = start + len(body) + len(tail)
        self.turns += 1
        self.open = role != "assistant"
        return None if self.open else self.example(start, start + len(body), self.turns - 1)

    def close(self) -> tuple | None:
        return self.example(self.chars, self.chars, self.turns) if self.open else None

    def example(self, start: int, end: int, context: int) -> tuple:
        self.examples += 1
        self.parts = ["".join(self.parts)]
        return (self.conv, self.examples - 1, context, self.parts[0], start, end)


def expand(turns: DataFrame) -> DataFrame:
    """Examples of turns(conv_id, turn, role, text); a conversation's examples follow each other in one partition."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in EXAMPLES.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now = None
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    if now and (x := now.close()):
                        yield x
                    now = Expansion(conv)
                if x := now.add(role, text):
                    yield x
        if now and (x := now.close()):
            yield x

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for row in rows(batches):
            held.append(row)
            chars += len(row[3])
            if chars > BATCH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held, chars = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    own = bound_batches(turns).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return placed.mapInArrow(examples, EXAMPLES)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation what the formatted examples say when they are read back."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, last, formatted, chars, loss_chars, loss = [], None, "", 0, 0, hashlib.sha256()

        def close():
            turns = turns_of(formatted)
            sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            return (last[0], len(turns), sha, loss_chars, loss.hexdigest(), chars)

        for batch in batches:
            for conv, text, start, end in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if last is None or last[0] != conv:
                    if last:
                        done.append(close())
                    last, chars, loss_chars, loss = (conv,), 0, 0, hashlib.sha256()
                target = unescape(text[start:end])
                formatted, chars, loss_chars = text, chars + len(text), loss_chars + len(target)
                loss.update(target.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done])
                done = []
        if last:
            yield pa.RecordBatch.from_pylist([dict(zip(names, close(), strict=True))])

    return examples.mapInArrow(read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
