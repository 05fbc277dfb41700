"""Ranked search by exact inner products of sparse vectors, with ball trees over the documents.

Terms, weights and scores are those of ``search``'s docstring. A document's vector has, for each
term of the items, ``weight * impact``; an item's vector counts the term's repeats; their inner
product is the score. Documents are taken in lots, each with a tree of its own: lots are halved
along the line between two far documents until leaves are small. A node knows the centroid of
its documents and, for each of ``SLICES`` slices of the terms, a radius: how far its documents
lie from the centroid there. So no document below a node scores more than

    item . centroid + sum over slices of |item's slice| * radius of the slice

Bounds are computed in doubles and rounded up by more than all their rounding errors can be.
Nodes are looked at best-first; a subtree whose bound is below the item's k-th best score so far
is left out, a leaf is scored exactly in 64-bit integers. The k-th best scores are carried from
lot to lot of a task, and each task hands on its k best documents per item.

How it is spread: documents never move; two narrow passes read them, one for the counts of the
items' terms, one for the search. Items go to the tasks in blocks of ``BLOCK_BYTES`` of terms,
one broadcast each; usually there is one. The best of the tasks are first joined in ``SALTS``
parts per item.

Defined results: a null text, of a document or an item, has no terms; an item without a score
above 0 gives no rows; each row of the items is searched, so rows with equal item ids give ranks
each; equal documents are documents of their own; equal scores rank by ascending id, null ids
last; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import IntegralType

from continuum.llm.terms import folded, item_blocks, utf8

TOP = 10
LENGTH_PERCENT = 75  # how much of a score's length part follows the document's length
BLOCK_BYTES = 1 << 18  # item terms of one pass; a task's centroids stay below NODE_CELLS doubles
LOT = 4096  # documents of a tree
LOT_CELLS = 1 << 21  # or so many vector entries, if these come first
LEAF = 32
NODE_CELLS = 1 << 23
SLICES = 256
SALTS = 32
SLACK = 1e-9  # relative; sums of a few million doubles err by less than 1e-9 of their absolute sum


class Terms:
    """The different terms of a block of items, numbered."""

    def __init__(self, block: list[tuple[str | None, list[bytes]]]):
        self.number = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        self.items = [(item, Counter(self.number[t] for t in terms)) for item, terms in block]

    def vectors(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of terms of each text; then text, term and occurrences of each entry."""
        n, ids = [], []
        find = self.number.get
        for text in texts:
            words = folded(text)
            n.append(len(words))
            ids.append(np.array([i for i in map(find, words) if i is not None], np.int64))
        sizes = [len(x) for x in ids]
        size = max(1, len(self.number))
        code = np.repeat(np.arange(len(n)), sizes) * size + np.concatenate([*ids, np.empty(0, np.int64)])
        code, tf = np.unique(code, return_counts=True)
        return np.array(n, np.int64), code // size, code % size, tf.astype(np.int64)


def _count(terms):
    """Documents that hold each term; as term -1 all with a term, their terms in ``total``."""

    def run(batches):
        for batch in batches:
            n, _, term, _ = terms.value.vectors(batch["text"])
            df = np.bincount(term, minlength=1)
            held = np.flatnonzero(df)
            yield pd.DataFrame(
                {"term": np.append(-1, held), "df": np.append((n > 0).sum(), df[held]), "total": np.append(n.sum(), df[held])}
            )

    return run


class Weights:
    """What the corpus says about the terms, and the items' vectors."""

    def __init__(self, terms: Terms, n_docs: int, n_terms: int, df: np.ndarray):
        self.terms, self.n_docs, self.n_terms = terms, n_docs, max(n_terms, 1)
        ratio = ((2 * n_docs + 2) / (2 * d + 1) for d in df.tolist())
        self.weight = np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)
        self.queries = []
        for _, counts in terms.items:
            known = sorted(t for t in counts if df[t] and self.weight[t] > 0)
            self.queries.append((np.array(known, np.int64), np.array([counts[t] for t in known], np.int64)))

    def values(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and value of each entry with a value, and the number of texts."""
        n, text, term, tf = self.terms.vectors(texts)
        m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * self.n_docs) // self.n_terms
        value = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[text]))
        some = value > 0
        return text[some], term[some], value[some], len(n)


class Tree:
    """A ball tree over one lot of documents."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int, n_terms: int):
        self.n_terms = n_terms
        size = max(1, n_terms)
        most = max(1, NODE_CELLS // (2 * size))  # leaves whose centroids may be held
        depth = 0
        while n_docs > LEAF << depth and 2 << depth <= most:
            depth += 1
        part = self._halve(doc, term, value, n_docs, depth)
        self.leaves = 1 << depth
        # Entries in order of leaf and term, for scoring.
        order = np.argsort(part[doc] * size + term, kind="stable")
        self.doc, self.value = doc[order], value[order]
        self.code = (part[doc] * size + term)[order]
        self._balls(part, doc, term, value.astype(float), n_docs, depth)

    def _halve(self, doc, term, value, n_docs: int, depth: int) -> np.ndarray:
        """The leaf of each document: halves by projection on the line between two far documents."""
        sketch = np.zeros((n_docs, 64))
        sign = np.where((term * 0x9E3779B1 >> 7) & 1, 1.0, -1.0)
        np.add.at(sketch, (doc, (term * 0x85EBCA6B >> 11) & 63), sign * value)
        part = np.zeros(n_docs, np.int64)
        for _ in range(depth):
            new = part * 2
            for node in np.unique(part):
                members = np.flatnonzero(part == node)
                points = sketch[members]
                far = points[((points - points.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                other = points[((points - far) ** 2).sum(axis=1).argmax()]
                along = np.argsort(points @ (other - far), kind="stable")
                new[members[along[len(members) // 2 :]]] += 1
            part = new
        return part

    def _balls(self, part, doc, term, value, n_docs: int, depth: int) -> None:
        """Centroids and radii by slices of terms, of nodes 1 (the root) to 2 * leaves - 1."""
        size = max(1, self.n_terms)
        nodes = 2 * self.leaves
        self.centre = np.zeros((nodes, size))
        self.radius = np.zeros((nodes, SLICES))
        slice_ = term % SLICES
        own = np.bincount(doc * SLICES + slice_, value**2, n_docs * SLICES).reshape(n_docs, SLICES)
        low = self.leaves
        total = np.bincount(part[doc] * size + term, value, low * size).reshape(low, size)
        count = np.bincount(part, minlength=low).astype(float)
        step = 0
        while True:
            at = part >> step
            centre = total / np.maximum(count, 1)[:, None]
            squared = np.pad(centre**2, ((0, 0), (0, -size % SLICES))).reshape(low, -1, SLICES).sum(axis=1)
            cross = np.bincount(doc * SLICES + slice_, value * centre[at[doc], term], n_docs * SLICES)
            both = own + squared[at]
            distance = np.maximum(both - 2 * cross.reshape(n_docs, SLICES), 0) + SLACK * both
            order = np.argsort(at, kind="stable")
            first = np.searchsorted(at[order], np.arange(low))
            filled = np.flatnonzero(count)
            self.centre[low : 2 * low] = centre
            if len(filled):
                self.radius[low + filled] = np.sqrt(np.maximum.reduceat(distance[order], first[filled], axis=0))
            if low == 1:
                return
            low, step = low // 2, step + 1
            total, count = total[::2] + total[1::2], count[::2] + count[1::2]

    def bounds(self, nodes: list[int], terms: np.ndarray, counts: np.ndarray, norms: np.ndarray) -> list[float]:
        """No document below the nodes scores more."""
        exact = self.centre[nodes][:, terms] @ counts + self.radius[nodes] @ norms
        return (exact * (1 + SLACK) + 1).tolist()

    def scores(self, leaf: int, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a leaf with a score, and their exact scores."""
        code = leaf * max(1, self.n_terms) + terms
        low, high = np.searchsorted(self.code, code, "left"), np.searchsorted(self.code, code, "right")
        size = high - low
        at = np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)
        if not len(at):
            return at, at
        docs, place = np.unique(self.doc[at], return_inverse=True)
        total = np.zeros(len(docs), np.int64)
        np.add.at(total, place, self.value[at] * np.repeat(counts, size))
        return docs, total


class Best:
    """The best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.rows, self.scores = k, [], []

    def least(self) -> int:
        """What a score must reach to matter."""
        return self.scores[0] if len(self.scores) == self.k else 1

    def add(self, score: int, key) -> None:
        if score < self.least():
            return
        (heapq.heappushpop if len(self.scores) == self.k else heapq.heappush)(self.scores, score)
        self.rows.append((-score, key))
        if len(self.rows) > 8 * self.k:
            self.rows = self.top()

    def top(self) -> list[tuple]:
        return sorted(self.rows)[: self.k]


def best_first(tree: Tree, terms: np.ndarray, counts: np.ndarray, best: Best, keys: list) -> int:
    """Looks for better documents in a tree; returns how many leaves were scored."""
    norms = np.sqrt(np.bincount(terms % SLICES, counts.astype(float) ** 2, SLICES))
    looked = 0
    heap = [(-tree.bounds([1], terms, counts, norms)[0], 1)]
    while heap:
        bound, node = heapq.heappop(heap)
        if -bound < best.least():
            break
        if node >= tree.leaves:
            looked += 1
            for doc, score in zip(*(x.tolist() for x in tree.scores(node - tree.leaves, terms, counts)), strict=True):
                best.add(score, keys[doc])
        else:
            children = [2 * node, 2 * node + 1]
            for child, b in zip(children, tree.bounds(children, terms, counts, norms), strict=True):
                heapq.heappush(heap, (max(-b, bound), child))
    return looked


def _search(weights, k: int, integers: bool):
    def run(batches):
        known = weights.value
        best = [Best(k) for _ in known.queries]
        waiting: list[tuple] = []
        keys: list = []

        def look() -> None:
            if keys:
                doc, term, value = (np.concatenate(x) for x in zip(*waiting, strict=True))
                tree = Tree(doc, term, value, len(keys), len(known.weight))
                for (terms, counts), found in zip(known.queries, best, strict=True):
                    if len(terms):
                        best_first(tree, terms, counts, found, keys)
            waiting.clear()
            keys.clear()

        cells = 0
        for batch in batches:
            for start in range(0, len(batch), 512):
                some = batch.iloc[start : start + 512]
                doc, term, value, n = known.values(some["text"])
                if cells + len(doc) > LOT_CELLS or len(keys) + n > LOT:
                    look()
                    cells = 0
                waiting.append((doc + len(keys), term, value))
                # Ids sort as the column does, nulls last.
                keys += [(x is None, "" if x is None else int(x) if integers else x) for x in some["key"]]
                cells += len(doc)
        look()
        made = [
            (i, None if null else str(key), -score)
            for i, found in enumerate(best)
            for score, (null, key) in found.top()
        ]
        yield pd.DataFrame(made, columns=["item", "key", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, limit: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    N documents have a term, L terms in all; df documents hold a term, w = floor(1000 * ln((2N + 2) /
    (2df + 1))). A document of n terms has m = 100 - 75 + (75 * n * N) div L, and its score adds, for
    each term of the item, repeats included, w * ((10**9 * tf) div (1000 * tf + 8 * m)).
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    # Ids travel as text: in pandas, a null beside them would turn large numbers into floats.
    rows = docs.select(F.col("doc_id").cast("string").alias("key"), utf8(F.col("text")).alias("text"))
    passes = []
    for block in item_blocks(items, limit):
        terms = Terms(block)
        sent = spark.sparkContext.broadcast(terms)
        counted = rows.select("text").mapInPandas(_count(sent), "term long, df long, total long")
        found = counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).toPandas()
        sent.unpersist()
        overall = found[found["term"] < 0]
        df = np.zeros(len(terms.number), np.int64)
        held = found[found["term"] >= 0]
        df[held["term"]] = held["df"]
        weights = Weights(terms, int(overall["df"].sum()), int(overall["total"].sum()), df)
        best = rows.mapInPandas(
            _search(spark.sparkContext.broadcast(weights), k, isinstance(kind, IntegralType)),
            "item int, key string, score long",
        ).select("item", F.col("key").cast(kind).alias("doc_id"), "score")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for parts in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))], ["item"]):
            rank = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
            best = best.withColumn("rank", rank).filter(F.col("rank") <= k)
        ids = F.lit([item for item, _ in block]) if any(i is not None for i, _ in block) else F.array(F.lit(None))
        item_id = F.element_at(ids.cast("array<string>"), F.col("item") + 1).cast(items.schema["item_id"].dataType)
        passes.append(best.select(item_id.alias("item_id"), "rank", "doc_id", "score"))
    if not passes:
        schema = [items.schema["item_id"].dataType, kind]
        empty = f"item_id {schema[0].simpleString()}, rank int, doc_id {schema[1].simpleString()}, score long"
        return spark.createDataFrame([], empty)
    return functools.reduce(DataFrame.unionByName, passes)
