"""Benchmark passages in documents by Wu-Manber multi-pattern search.

A window is ``window`` consecutive terms of a benchmark item, written as bytes with one space
before, between and after them; an item of fewer terms, but not none, is one window. Documents
are written in the same way, so that a window occurs where its bytes occur.

Windows are grouped by the power of two of their length. For a group, ``m`` is the least length
and a block is the last few bytes of ``m``, more of them the more windows there are. The shift
table tells for each block how far the search may move on without passing a window: all of
``m`` less the block where no window has it. Where the shift is nothing, the windows whose first
``m`` bytes end with this block are looked up in its bucket, compared by their first eight bytes,
and then directly, byte by byte.

The search moves through a batch of documents in many places at once: the batch is one array of
bytes, cut into stretches, and each step moves on in all stretches that are not at their end.

How it is spread: documents never move. The benchmark goes to the tasks in blocks of
``BLOCK_BYTES`` of terms, one broadcast and one pass over the documents each; usually there is one.
With more, what the passes find is put together by document, without the texts.

Defined results: a null text, of a document or an item, has no terms, and an item without
terms occurs nowhere; rows with equal item ids are one item; a null item id stands as an empty
string; equal documents are searched each; null document ids are allowed; an empty benchmark
leaves all documents clean; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuum.llm.store import stored
from continuum.llm.terms import folded, item_blocks, utf8

WINDOW = 10
BLOCK_BYTES = 4 << 20  # benchmark terms of one pass; its tables take about forty times as much
STRETCH = 2048  # bytes that one place of the search walks through
BATCH = 8 << 20  # bytes that are searched together
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_EDGE = b"\n"  # between documents; no window has it


def _code(text: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes before each ``end`` as a number."""
    code = np.zeros(len(end), np.uint64)
    for k in range(size, 0, -1):
        code = (code << np.uint64(8)) | text[end - k]
    return code


class Group:
    """Shift and bucket tables for windows of similar length."""

    def __init__(self, strings: list[bytes], numbers: list[int]):
        self.strings, self.numbers = strings, np.array(numbers)
        self.m = m = min(map(len, strings))
        self.size = min(m, 8, max(2, math.ceil(math.log(2 * m * len(strings), 16))))
        self.bits = min(24, max(10, math.ceil(math.log2(8 * m * len(strings)))))
        heads = np.frombuffer(b"".join(s[:m] for s in strings), np.uint8)
        starts = np.arange(len(strings)) * m
        self.shift = np.full(1 << self.bits, m - self.size + 1, np.int32)
        for end in range(self.size, m + 1):  # the last one, of shift 0, stands
            self.shift[self._slot(heads, starts + end)] = np.minimum(
                self.shift[self._slot(heads, starts + end)], m - end
            )
        last = self._slot(heads, starts + m)
        self.order = np.argsort(last, kind="stable")
        self.slots = last[self.order]
        self.prefix = _code(heads, starts + min(m, 8), min(m, 8))

    def _slot(self, text: np.ndarray, end: np.ndarray) -> np.ndarray:
        return ((_code(text, end, self.size) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of stretches of ``m`` bytes and their slots, where no shift is possible."""
        end = np.arange(self.m, len(text) + 1, STRETCH)
        stop = np.minimum(end + STRETCH, len(text) + 1)
        ends, slots = [], []
        while len(end):
            slot = self._slot(text, end)
            shift = self.shift[slot]
            ends.append(end[shift == 0])
            slots.append(slot[shift == 0])
            end = end + np.maximum(shift, 1)
            going = end < stop
            end, stop = end[going], stop[going]
        return np.concatenate([*ends, np.empty(0, np.int64)]), np.concatenate([*slots, np.empty(0, np.int64)])

    def find(self, raw: bytes, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all occurrences, and the numbers of the windows that occur there."""
        end, slot = self.candidates(text)
        low, high = (np.searchsorted(self.slots, slot, side=s) for s in ("left", "right"))
        size = high - low
        start = np.repeat(end - self.m, size)
        which = self.order[np.arange(len(start)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)]
        first = min(self.m, 8)
        near = _code(text, start + first, first) == self.prefix[which]
        start, which = start[near], which[near]
        same = [raw.startswith(self.strings[w], s) for s, w in zip(start.tolist(), which.tolist(), strict=True)]
        same = np.array(same, bool)
        return start[same], self.numbers[which[same]]


class Windows:
    """All windows of a block of items, each once, with the items that have them."""

    def __init__(self, block: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        of: dict[bytes, set[str]] = defaultdict(set)
        self.n_terms: list[int] = []
        for item, terms in block:
            size = min(window, len(terms))
            for i in range(len(terms) - size + 1 if size else 0):
                of[b" %b " % b" ".join(terms[i : i + size])].add(item or "")
        groups: dict[int, tuple[list[bytes], list[int]]] = defaultdict(lambda: ([], []))
        for number, string in enumerate(of):
            strings, numbers = groups[len(string).bit_length()]
            strings.append(string)
            numbers.append(number)
            self.n_terms.append(string.count(b" ") - 1)
        self.items = [sorted(x) for x in of.values()]
        self.groups = [Group(*g) for g in groups.values()]

    def search(self, texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[list[str]]]:
        """Per text: the places of its terms that lie in a window, and the items of these windows."""
        parts = [b" %b " % b" ".join(t) if t else b"" for t in texts]
        raw = _EDGE.join([b"", *parts])
        text = np.frombuffer(raw, np.uint8)
        n = np.array([len(t) for t in texts])
        first_term = np.cumsum(n) - n
        # A text of n terms has n + 1 spaces: the start of a window is the space before its first term.
        spaces = np.flatnonzero(text == 32)
        first_space = np.cumsum(n + (n > 0)) - (n + (n > 0))
        hits = np.zeros(n.sum() + 1, np.int64)
        pairs = []
        for group in self.groups:
            start, window = group.find(raw, text)
            if len(start):
                space = np.searchsorted(spaces, start)
                owner = np.searchsorted(first_space, space, side="right") - 1
                term = first_term[owner] + space - first_space[owner]
                np.add.at(hits, term, 1)
                np.add.at(hits, term + np.array(self.n_terms)[window], -1)
                pairs.append(np.unique(np.stack([owner, window]), axis=1))
        items: list[set[str]] = [set() for _ in texts]
        for owner, window in np.concatenate(pairs, axis=1).T.tolist() if pairs else []:
            items[owner].update(self.items[window])
        covered = np.cumsum(hits[:-1]) > 0
        places = [np.flatnonzero(x).astype(np.int32) for x in np.split(covered, first_term[1:])] if texts else []
        return places, [sorted(x) for x in items]


_FOUND = "key string, node binary, n_words long, hits array<int>, items array<string>"


def _search(windows, every: bool):
    """Rows of all documents, or only of those with an occurrence."""

    def flush(rows):
        places, items = windows.value.search([t for _, _, t in rows])
        made = [
            (key, node, len(t), p, i) for (key, node, t), p, i in zip(rows, places, items, strict=True) if every or i
        ]
        return pd.DataFrame(made, columns=["key", "node", "n_words", "hits", "items"])

    def run(batches):
        for batch in batches:
            rows, load = [], 0
            for key, node, text in zip(batch["key"], batch["node"], batch["text"], strict=True):
                rows.append((key, node, folded(text)))
                load += len(text) + 1
                if load >= BATCH:
                    yield flush(rows)
                    rows, load = [], 0
            if rows:
                yield flush(rows)

    return run


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, hits, items`` for each row of ``docs(doc_id, text)``.

    ``hits`` are the places, from 0, of the terms inside any occurrence of a window of
    ``benchmark(item_id, text)``; ``items`` are the ids, as sorted strings, of the items that occur.
    """
    spark = docs.sparkSession
    # Ids travel as text: in pandas, a null beside them would turn large numbers into floats.
    rows = docs.select(F.col("doc_id").cast("string").alias("key"), utf8(F.col("text")).alias("text"))
    rows = rows.withColumn("node", F.unhex(F.md5("text")))
    blocks = item_blocks(benchmark, limit, window - 1)
    block, following = next(blocks, []), next(blocks, None)
    found = rows.mapInPandas(_search(spark.sparkContext.broadcast(Windows(block, window)), True), _FOUND)
    if following is not None:
        found = stored(found, "passages")
        more = [found.filter(F.size("items") > 0)]
        while following is not None:
            sent = spark.sparkContext.broadcast(Windows(following, window))
            more.append(stored(rows.mapInPandas(_search(sent, False), _FOUND), "passages"))
            sent.unpersist()
            following = next(blocks, None)
        both = functools.reduce(DataFrame.unionByName, more).groupBy("node").agg(
            *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items")]
        )
        found = found.select("key", "node", "n_words").join(both.hint("merge"), "node", "left").select(
            "key", "n_words",
            F.coalesce("hits", F.array().cast("array<int>")).alias("hits"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    kind = docs.schema["doc_id"].dataType
    return found.select(F.col("key").cast(kind).alias("doc_id"), "n_words", "hits", "items")


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of what ``occurrences`` found."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
