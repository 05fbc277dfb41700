"""Chat formatting in budgeted windows.

A turn is written as ``<|im_start|>role`` newline ``text<|im_end|>`` newline. Inside roles and
texts one backslash is put behind the ``<`` of every ``<|``, ``<\\|``, ``<\\\\|``, ..., which is
undone by taking it out again, so no text can open or close a turn. In roles, backslashes and
line breaks are escaped first.

A conversation becomes windows of whole turns with at most ``BUDGET`` tokens. Prefix sums of
the turns' tokens choose the spans: a window takes turns while they fit; the next one repeats
the system turn, if the conversation starts with one, and as many of the last turns as fit into
``HISTORY`` tokens and leave room for the next turn. A turn that is longer than the budget by
itself stands in a window of its own that exceeds it; nothing is cut. The loss mask covers the
texts of assistant turns that are new in their window, so each is learnt from once.

Turns are sorted inside partitions and read as a stream, so memory holds a window, not a
conversation. One conversation stays in one task, as its digest runs over all its turns in order.

Defined results: null texts are empty, null roles too; turns with equal numbers follow each
other by role and text, equal rows are turns of their own; null turn numbers come first; turns
without a conversation id are one conversation; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuum.llm import tokens

BUDGET = 1024
HISTORY = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escaped(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


class Turn:
    def __init__(self, role: str, text: str, count):
        self.head = f"{OPEN}{escaped_role(role)}\n"
        self.body = escaped(text)
        self.whole = f"{self.head}{self.body}{CLOSE}\n"
        self.learnt = role == "assistant"
        self.system = role == "system"
        self.tokens = count(self.whole)


class Windows:
    """The windows of one conversation, turn by turn."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: Turn | None = None
        self.repeated: list[Turn] = []
        self.new: list[Turn] = []
        self.used = 0
        self.number = 0
        self.started = False

    def add(self, turn: Turn) -> Iterator[tuple]:
        if self.new and self.used + turn.tokens > self.budget:
            yield self.window()
            self._begin(turn)
        if not self.started:
            self.started = True
            self.system = turn if turn.system else None
        self.new.append(turn)
        self.used += turn.tokens

    def _begin(self, turn: Turn) -> None:
        """Repeats the system turn and the longest history that fits before the next turn."""
        past = [t for t in self.repeated + self.new if t is not self.system]
        sums = np.cumsum([0, *(t.tokens for t in past)])
        fixed = self.system.tokens if self.system else 0
        room = min(self.history, self.budget - fixed - turn.tokens)
        first = int(np.searchsorted(sums, sums[-1] - room)) if room > 0 else len(past)
        self.repeated = ([self.system] if self.system else []) + past[first:]
        self.new = []
        self.used = fixed + int(sums[-1] - sums[first])

    def window(self) -> tuple:
        parts, spans, at = [], [], 0
        for i, turn in enumerate(self.repeated + self.new):
            parts.append(turn.whole)
            if turn.learnt and i >= len(self.repeated):
                start = at + len(turn.head)
                spans.append({"start": start, "end": start + len(turn.body)})
            at += len(turn.whole)
        result = (self.number, "".join(parts), len(self.repeated), self.used, spans)
        self.number += 1
        return result


WINDOW = "window int, text string, n_repeated int, n_tokens long, loss array<struct<start: long, end: long>>"


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = None) -> DataFrame:
    """``conv_id, window, text, n_repeated, n_tokens, loss`` in order within each partition.

    ``n_repeated`` turns at the start of the text were in an earlier window; ``loss`` holds
    spans of characters to learn from.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoder(vocabulary)
        count = lambda text: len(encoder.ids(text)) // 4
        current, key = None, None
        for batch in batches:
            rows = []
            for new_key, role, text in zip(batch["key"], batch["role"], batch["text"], strict=True):
                if current is None or new_key != key:
                    if current is not None:
                        rows.append((key, *current.window()))
                    current, key = Windows(budget, history), new_key
                rows += [(key, *w) for w in current.add(Turn(role, text, count))]
            yield pd.DataFrame(rows, columns=["key", "window", "text", "n_repeated", "n_tokens", "loss"])
        if current is not None:
            yield pd.DataFrame(
                [(key, *current.window())], columns=["key", "window", "text", "n_repeated", "n_tokens", "loss"]
            )

    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    # Ids travel as text: in pandas, a null beside them would turn large numbers into floats.
    told = ordered.select(F.col("conv_id").cast("string").alias("key"), "role", "text")
    kind = turns.schema["conv_id"].dataType
    return told.mapInPandas(write, f"key string, {WINDOW}").select(
        F.col("key").cast(kind).alias("conv_id"), "window", "text", "n_repeated", "n_tokens", "loss"
    )


class Reading:
    """What the windows of one conversation say, read in order."""

    def __init__(self):
        self.turns, self.chars, self.loss = 0, 0, 0
        self.said, self.learnt = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, n_repeated: int, loss) -> None:
        self.chars += len(text)
        for i, (role, body) in enumerate(_TURN.findall(text)):
            if i >= n_repeated:
                self.turns += 1
                self.said.update(f"{unescaped_role(role)}\n{unescaped(body)}\n".encode("utf-8", "replace"))
        for span in loss:
            part = unescaped(text[span["start"] : span["end"]])
            self.loss += len(part)
            self.learnt.update(part.encode("utf-8", "replace"))

    def row(self, key) -> tuple:
        return key, self.turns, self.said.hexdigest(), self.loss, self.learnt.hexdigest(), self.chars


_READ = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, key = None, None
    for batch in batches:
        rows = []
        for new_key, text, n_repeated, loss in zip(
            batch["key"], batch["text"], batch["n_repeated"], batch["loss"], strict=True
        ):
            if current is None or new_key != key:
                if current is not None:
                    rows.append(current.row(key))
                current, key = Reading(), new_key
            current.add(text, n_repeated, loss)
        yield pd.DataFrame(rows, columns=_READ)
    if current is not None:
        yield pd.DataFrame([current.row(key)], columns=_READ)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, from what ``windows`` wrote and in its order."""
    kind = formatted.schema["conv_id"].dataType
    rows = formatted.select(F.col("conv_id").cast("string").alias("key"), "text", "n_repeated", "loss")
    schema = (
        "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return rows.mapInPandas(_read, schema).select(F.col("key").cast(kind).alias("conv_id"), *_READ[1:])
