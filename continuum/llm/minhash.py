"""Near-duplicate documents by DartMinHash signatures, banded joining and an exact check.

A text is the multiset of its five-word windows; its likeness to another is the weighted
Jaccard similarity, the sum of the smaller counts over the sum of the larger. A window with
count c is c unit cells. Darts fall on each cell at places and in numbers that depend on the
cell's hash alone, thickly enough along a rank axis; every dart belongs to one of the
coordinates, and a coordinate keeps the earliest dart that falls on the text. Ranks are walked
in strips of doubling width, until all coordinates of a text are met, so a long text looks at
narrow strips only and a short one throws many darts per cell.

Equal texts are one node from the start. Nodes that share a band are candidates, and whole texts
decide. First all members of a band group are compared with its leader. Where a group then still
holds several classes, it is split by size: texts are alike only if their numbers of windows
are within the threshold of each other, so a member meets those of its own and the next band of
sizes. In what then still holds several classes, the members outside the largest class are compared
with all members by an inverted index of cells, in blocks of bounded size, and only the links that
join classes are kept. So no link between classes is lost among candidates, and pairs within a
class are not formed.

The threshold is a parameter; the bands are made for 0.8, where a pair is missed with probability
3e-6 (at 0.7 with 1.4e-3, at 0.6 with 4e-2).

Defined results: a null text is empty; empty texts are one class; texts of fewer than five
words are alike only if their words are; rows with equal ids or wholly equal rows are rows of
their own; an empty table gives no rows; other columns are carried by ``one_per_class`` and
not read.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import BooleanType

from continuum.llm import words
from continuum.llm.components import components
from continuum.sources.shared import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 24  # with 4 coordinates each, a pair at 0.8 is missed with probability 3e-6
ROWS = 4
FIRST_STRIP = 2.0**-5
BLOCK = 2000
SALTS = 16
MAX_CELLS = 1 << 18  # cells that are signed together


@cache
def _strip(number: int) -> tuple[float, float, np.ndarray]:
    """Start and width of a strip of ranks, and the distribution of darts per cell in it."""
    start = 0.0 if number == 0 else FIRST_STRIP * 2.0 ** (number - 1)
    width = FIRST_STRIP if number == 0 else start
    most = int(width + 12 * math.sqrt(width) + 20)
    logs = [n * math.log(width) - width - math.lgamma(n + 1) for n in range(most)]
    return start, width, np.cumsum(np.exp(logs))


def cells(windows: np.ndarray) -> np.ndarray:
    """One hash per unit cell: equal windows differ by their running number."""
    h = np.sort(windows)
    place = np.arange(len(h))
    first = np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]], place, 0))
    return words.mix(h + (place - first).astype(np.uint64) * words.GOLDEN)


def signatures(texts: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """A row of ``size`` dart names per array of cells; arrays without cells give zeros."""
    result = np.zeros(len(texts) * size, np.uint64)
    met = np.zeros(len(texts) * size, bool)
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in texts])
    seed = np.concatenate(texts) if texts else np.empty(0, np.uint64)
    number = 0
    while len(seed):
        start, width, shares = _strip(number)
        salted = words.mix(seed + words.multiple(number + 1))
        chance = words.unit(salted)
        hit = np.flatnonzero(chance >= shares[0])
        darts = np.searchsorted(shares, chance[hit], side="right")
        cell = np.repeat(hit, darts)
        turn = np.arange(len(cell)) - np.repeat(np.cumsum(darts) - darts, darts)
        name = words.mix(salted[cell] + (turn + 1).astype(np.uint64) * words.GOLDEN)
        slot = owner[cell] * size + ((name >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        open_ = ~met[slot]
        slot, name = slot[open_], name[open_]
        rank = start + width * words.unit(words.mix(name))
        late_first = np.argsort(-rank, kind="stable")  # the earliest is written last and stays
        result[slot[late_first]] = name[late_first]
        met[slot] = True
        going = ~met.reshape(-1, size).all(axis=1)[owner]
        owner, seed, number = owner[going], seed[going], number + 1
    return result.reshape(-1, size)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each signature."""
    total = np.zeros((len(signature), BANDS), np.uint64)
    for k in range(ROWS):
        total = words.mix(total + signature[:, k::ROWS]) + words.GOLDEN
    return words.mix(total + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two texts; 1 for two empty ones."""
    x, y = words.shingles(a, SHINGLE), words.shingles(b, SHINGLE)
    if not len(x) and not len(y):
        return 1.0
    u, n = np.unique(x, return_counts=True)
    v, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(x) + len(y) - both)


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _signed(docs: DataFrame) -> DataFrame:
    """``node, n, bands``: for each text its number of windows and its band keys."""

    def sign(batches):
        for batch in batches:
            batch = batch.drop_duplicates("node")
            found, nodes, pending, load = [], [], [], 0
            for node, text in zip(batch["node"], batch["text"], strict=True):
                c = cells(words.shingles(text.encode(), SHINGLE))
                if not len(c):
                    continue
                nodes.append(node)
                pending.append(c)
                load += len(c)
                if load >= MAX_CELLS:
                    found += [(len(x), k) for x, k in zip(pending, band_keys(signatures(pending)))]
                    pending, load = [], 0
            found += [(len(x), k) for x, k in zip(pending, band_keys(signatures(pending)))]
            if nodes:
                yield pd.DataFrame(
                    {"node": nodes, "n": [n for n, _ in found], "bands": [k for _, k in found]}
                )

    texts = docs.select(node_of(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(sign, "node binary, n long, bands array<long>")


def _alike(threshold: float):
    @F.pandas_udf(BooleanType())
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(
            [similarity(x.encode(), y.encode()) >= threshold for x, y in zip(a, b, strict=True)], dtype=bool
        )

    return alike


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text``, once per node, for the given nodes."""
    keyed = docs.select("doc_id", node_of(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = keyed.groupBy("node").agg(F.min("doc_id").alias("_id")).join(nodes, "node")
    same = (keyed["node"] == chosen["node"]) & keyed["doc_id"].eqNullSafe(chosen["_id"])
    found = keyed.join(chosen.hint("merge"), same, "left_semi")
    first = Window.partitionBy("doc_id", "node").orderBy(F.lit(0))
    return found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("node", "text")


def shared_cells(texts: list[np.ndarray], some: np.ndarray) -> np.ndarray:
    """For each of the arrays numbered ``some``, how many cells it shares with every array."""
    sizes = [len(c) for c in texts]
    cell, inverse = np.unique(np.concatenate(texts), return_inverse=True)
    owner = np.repeat(np.arange(len(texts)), sizes)[np.argsort(inverse, kind="stable")]
    stop = np.cumsum(np.bincount(inverse, minlength=len(cell)))
    begin = np.cumsum(sizes) - sizes
    result = np.empty((len(some), len(texts)), np.int64)
    for row, i in enumerate(some):
        own = inverse[begin[i] : begin[i] + sizes[i]]
        size = stop[own] - np.where(own > 0, stop[own - 1], 0)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(stop[own] - size, size)
        result[row] = np.bincount(owner[at], minlength=len(texts))
    return result


def _join_groups(threshold: float):
    """Enough links to join what is alike in a group, beyond what is joined already."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        texts = [cells(words.shingles(t.encode(), SHINGLE)) for t in rows["text"]]
        group = pd.factorize(rows["comp"])[0]
        outside = np.flatnonzero(group != np.bincount(group).argmax())  # the largest class is joined
        n = np.array([len(c) for c in texts])
        own = rows["own"].to_numpy(bool)
        nodes = rows["node"].to_numpy()
        found = []
        for start in range(0, len(outside), 256):
            some = outside[start : start + 256]
            both = shared_cells(texts, some)
            alike = both >= threshold * (n[some][:, None] + n[None, :] - both)
            # Two members of the band of sizes below meet in their own group.
            for i, j in zip(*np.nonzero(alike & (own[some][:, None] | own[None, :])), strict=True):
                one, other = group[some[i]], group[j]
                if one != other:
                    group[group == one] = other
                    found.append((nodes[some[i]], nodes[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    return join


def _by_size(named: DataFrame, threshold: float) -> DataFrame:
    """``key, size`` groups: each member in the group of its band of sizes (``own``) and in the next."""
    band = F.floor(F.log("n") / (math.log(1 / threshold) * (1 + 1e-9))).cast("int") if threshold < 1 else F.col("n").cast("int")
    return named.withColumn("_band", band).select(
        "key", "node", "comp", F.inline(F.array(
            F.struct(F.col("_band").alias("size"), F.lit(True).alias("own")),
            F.struct((F.col("_band") + 1).alias("size"), F.lit(False).alias("own")),
        )),
    )


def _unsettled(group: DataFrame) -> DataFrame:
    """``key, size, c``: groups with members of several classes, one of each with equal members."""
    kinds = group.groupBy("key", "size").agg(
        F.count("*").alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("own").alias("any_own"),
        F.sum(F.xxhash64("node", "own").cast("decimal(38,0)")).alias("members"),
    )
    return kinds.filter("low <> high AND any_own").groupBy("c", "members").agg(F.min(F.struct("key", "size")).alias("g")).select("g.*", "c")


def links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``node, root`` for each different text that is linked to a lesser one."""
    signed = cut_lineage(_signed(docs).groupBy("node").agg(F.min("n").alias("n"), F.min("bands").alias("bands")))
    rows = signed.select("node", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    group = cut_lineage(rows.join(shared.hint("merge"), "key"))
    texts = cut_lineage(_texts_of(docs, group.select("node").distinct()))
    # First, everyone against the leader of each band group; leaders differ between bands.
    order = F.struct(F.xxhash64("key", "node").alias("o"), "node", "n")
    chosen = group.groupBy("key").agg(F.min(order).alias("lead"))
    lead = chosen.select("key", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("node", "n")])
    led = group.join(lead.hint("merge"), "key").filter("node <> lead_node")
    near = F.least("n", "lead_n") >= F.greatest("n", "lead_n") * threshold
    pairs = led.filter(near).select(
        F.least("node", "lead_node").alias("a"), F.greatest("node", "lead_node").alias("b")
    ).distinct()
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    linked = (
        pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        .filter(_alike(threshold)("text_a", "text_b")).select("a", "b")
    )
    forest = components(linked)
    # Then, within the groups that still hold several classes, everyone outside the largest
    # class against all. Leaders have been compared and stay out. A large group is dealt into
    # blocks, and each pair of blocks is a group of its own.
    named = cut_lineage(
        led.select("key", "node", "n").join(forest.hint("merge"), "node", "left")
        .select("key", "node", "n", F.coalesce("root", "node").alias("comp"))
    )
    sized = _by_size(named, threshold)
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int")
    dealt = (
        sized.join(_unsettled(sized).hint("merge"), ["key", "size"])
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "key", "size", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "comp", "own"
        )
    )
    more = dealt.join(texts.hint("merge"), "node").groupBy("key", "size", "x", "y").applyInPandas(
        _join_groups(threshold), "a binary, b binary"
    )
    return components(forest.toDF("a", "b").unionByName(more))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, n_members``: the least id of the class, and its number of rows.

    Rows are counted by text and texts by class, so a class is as many rows as it has different
    texts; what is known of a class goes back to them in ``SALTS`` parts.
    """
    members = docs.select("doc_id", node_of(F.col("text")).alias("node"))
    per_node = members.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    salt = F.when(F.col("root").isNotNull(), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    named = cut_lineage(
        per_node.join(links(docs, threshold).hint("merge"), "node", "left").select(
            "node", "least", "rows", F.coalesce("root", "node").alias("class"), salt.alias("salt")
        )
    )
    totals = named.groupBy("class").agg(
        F.min("least").alias("class_id"), F.sum("rows").alias("n_members"), F.count("*").alias("texts")
    )
    parts = F.when(F.col("texts") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = totals.select("class", "class_id", "n_members", F.explode(parts).alias("salt"))
    told = named.join(salted.hint("merge"), ["class", "salt"]).select("node", "class_id", "n_members")
    return members.join(told.hint("merge"), "node").select("doc_id", "class_id", "n_members")


def one_per_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of the least id; the columns of ``docs``."""
    packed = docs.select(F.struct("*").alias("_doc"), node_of(F.col("text")).alias("_node"))
    keyed = packed.withColumn("_id", F.col("_doc.doc_id"))
    members = docs.select("doc_id", node_of(F.col("text")).alias("node")).distinct()
    named = members.join(links(docs, threshold).hint("merge"), "node", "left")
    least = F.min(F.struct("doc_id", "node")).alias("first")
    chosen = named.groupBy(F.coalesce("root", "node")).agg(least).select("first.*")
    same = (F.col("_node") == F.col("node")) & F.col("_id").eqNullSafe(F.col("doc_id"))
    kept = keyed.join(chosen.hint("merge"), same, "left_semi")
    once = Window.partitionBy("_node", "_id").orderBy(F.lit(0))
    return kept.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("_doc.*")
