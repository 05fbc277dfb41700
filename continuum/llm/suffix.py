"""Removal of every byte inside a 200-byte string that occurs more than once.

Prefix doubling sorts positions by the pair (rank of a string, rank of the string a growing
offset further on), ranks again, and drops positions whose rank has become unique, until the
compared length is past the threshold. Here a rank is the content hash of the string, computed
where the text lies, so that ranks agree everywhere without a global sort and pairs are formed
by grouping. The rounds compare 72, 193 and 200 bytes:

1. Of the 129 strings of 72 bytes inside a window of 200, the one with the least hash is the
   window's anchor; equal windows have equal anchors. Only anchors (about one position in 65)
   enter the first round. Anchors whose 72-byte rank is unique are dropped, and with them all
   their windows.
2. An anchor that is left is ranked by the pair (its rank, rank of the stretch of text that its
   windows cover together). Where this pair repeats, all windows of the anchor repeat.
3. Of the rest, and of one anchor per repeated pair with the same 72-byte rank, the windows are
   taken in runs of eight by their distance from the anchor. A run is ranked by the pair (rank
   of its anchor, rank of the 193 bytes that all its windows share); where that is unique, no
   window repeats, and where the pair with the whole stretch of the run repeats, all do.
4. Of the runs that are left, every window is ranked by the pair (rank of its anchor, rank of
   the 200 bytes). Windows with a repeated pair repeat.

Wholly equal texts are processed once; a text that has a copy, and is long enough, loses all.
Pairs of two independent 64-bit ranks are compared, never the texts themselves.

Defined results: a null text is empty and loses nothing; texts under 200 bytes lose nothing,
copies or not; repeated rows count as copies; an empty table gives no rows; other columns are
carried by ``without_repeats`` and not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from continuum.llm import words
from continuum.llm.store import bucketed, stored
from continuum.sources.shared import cut_lineage

LENGTH = 200
GRAM = 72
CHOICES = LENGTH - GRAM + 1
MAX_POWERS = 1 << 20  # powers that a Python worker keeps; a longer text has its own
RUN = 8
RUNS = 1 << 5  # more than there are runs in a stretch
_PLACE = np.uint64((1 << 31) - 1)
_BASES = (0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        have = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (base, inverse))
        if size <= MAX_POWERS:
            _powers[base] = have
    return have


class Ranks:
    """64-bit content ranks of any substring of one text."""

    def __init__(self, data: bytes, base: int):
        n = len(data)
        up, self.down = _powers_of(base, n + 1)
        value = words.mix(np.arange(1, 257, dtype=np.uint64) * words.multiple(base))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value[np.frombuffer(data, np.uint8)] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return words.mix((self.sums[start + length] - self.sums[start]) * self.down[start])


def _running_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of ``width``, from running minima of blocks, both ways."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    """The anchors of one text: ``at``, and the windows ``first..last`` that each stands for."""

    def __init__(self, data: bytes):
        self.grams = Ranks(data, _BASES[0])
        starts = np.arange(len(data) - GRAM + 1)
        rank = self.grams.of(starts, GRAM)
        order = (rank & ~_PLACE) | starts.astype(np.uint64)  # the least rank, leftmost of equals
        owner = (_running_least(order, CHOICES) & _PLACE).astype(np.int64)
        self.first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        self.last = np.r_[self.first[1:], len(owner)] - 1
        self.at = owner[self.first]
        self.rank = rank[self.at].view(np.int64)
        self.data = data

    def stretches(self) -> np.ndarray:
        """Rank of the text that the windows of each anchor cover, and of where they lie in it."""
        span = self.last - self.first
        inner = Ranks(self.data, _BASES[1]).of(self.first, span + LENGTH)
        lie = (span * LENGTH + self.at - self.first).astype(np.uint64)
        return words.mix(inner + lie * words.GOLDEN).view(np.int64)

    def _owned(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank of the anchors at ``at``, and their least and greatest distance to a window."""
        i = np.searchsorted(self.at, at)
        return self.rank[i], at - self.last[i], at - self.first[i]

    def runs(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Codes, anchor ranks, shared ranks and stretch ranks of all runs of the anchors ``at``."""
        rank, near, far = self._owned(at)
        size = far // RUN - near // RUN + 1
        run = spread(near // RUN, size)
        at, rank, near, far = (np.repeat(x, size) for x in (at, rank, near, far))
        near, far = np.maximum(near, run * RUN), np.minimum(far, run * RUN + RUN - 1)
        ranks = Ranks(self.data, _BASES[1])
        core = ranks.of(at - run * RUN, LENGTH - RUN + 1).view(np.int64)
        lie = (near * LENGTH + far).astype(np.uint64)
        whole = words.mix(ranks.of(at - far, far - near + LENGTH) + lie * words.GOLDEN).view(np.int64)
        return at * RUNS + run, rank, core, whole

    def starts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows in the coded runs, and the ranks of their anchors."""
        at, run = codes // RUNS, codes % RUNS
        rank, near, far = self._owned(at)
        near, far = np.maximum(near, run * RUN), np.minimum(far, run * RUN + RUN - 1)
        size = far - near + 1
        return spread(at - far, size), np.repeat(rank, size)

    def windows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, anchor ranks and 200-byte ranks of the windows in the coded runs."""
        start, rank = self.starts(codes)
        return start, rank, Ranks(self.data, _BASES[1]).of(start, LENGTH).view(np.int64)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``first, first + 1, ...``, ``size`` of them, for each pair in turn."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


def spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by the windows at the ascending ``starts``."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.r_[True, np.diff(starts) > LENGTH])
    return starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]] + LENGTH


def _frame(columns: dict[str, list[np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in columns.items()})


def _find_anchors(batches):
    for batch in words.lots(batches):
        out = {"uid": [], "at": [], "rank": [], "stretch": []}
        for uid, text in zip(batch["uid"], batch["text"], strict=True):
            a = Anchors(text.encode())
            out["uid"].append(np.full(len(a.at), uid, np.int64))
            out["at"].append(a.at)
            out["rank"].append(a.rank)
            out["stretch"].append(a.stretches())
        yield _frame(out)


def _visit(of, names):
    """For texts with a list of numbers each: what ``of`` an ``Anchors`` finds for the list."""

    def find(batches):
        for batch in words.lots(batches):
            out = {"uid": [], **{n: [] for n in names}}
            for uid, text, at in zip(batch["uid"], batch["text"], batch["at"], strict=True):
                found = of(Anchors(text.encode()), np.sort(np.asarray(at, np.int64)))
                out["uid"].append(np.full(len(found[0]), uid, np.int64))
                for name, x in zip(names, found, strict=True):
                    out[name].append(x)
            yield _frame(out)

    return find


def _cut(batches):
    def numbers(x) -> np.ndarray:
        return np.asarray([] if x is None else x, np.int64)

    for batch in words.lots(batches):
        rows = []
        for node, text, at, runs, start in zip(
            *(batch[c] for c in ("node", "text", "at", "runs", "starts")), strict=True
        ):
            data = text.encode()
            found = [numbers(start)]
            at, runs = np.sort(numbers(at)), numbers(runs)
            if len(at) or len(runs):
                a = Anchors(data)
                i = np.searchsorted(a.at, at)
                found += [spread(a.first[i], a.last[i] - a.first[i] + 1), a.starts(runs)[0]]
            left, right = spans(np.unique(np.concatenate(found)))
            edge = [0, *np.stack([left, right], axis=1).ravel().tolist(), len(data)]
            kept = b"".join(data[x:y] for x, y in zip(edge[::2], edge[1::2], strict=True))
            rows.append((node, len(data) - len(kept), len(left), kept, kept.decode("utf-8", "ignore")))
        yield pd.DataFrame(rows, columns=["node", "n_removed", "n_spans", "kept", "clean"])


def settled(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Of ``uid, at, stretch`` and keys: the places known to repeat, and those to look into.

    Places with unique keys are dropped. Where keys and stretch repeat, all windows of the
    place repeat; one such place stands for its equals beside the ones to look into.
    """
    ranked = rows.groupBy(*keys).agg(F.count("*").alias("c"), (F.min("stretch") == F.max("stretch")).alias("same"))
    live = stored(rows.join(ranked.filter("c > 1").drop("c").hint("merge"), keys), f"live_{name}")
    mixed = live.filter("not same")
    pairs = mixed.groupBy(*keys, "stretch").agg(F.count("*").alias("c"), F.min(F.struct("uid", "at")).alias("first"))
    judged = stored(mixed.join(pairs.hint("merge"), [*keys, "stretch"]), f"judged_{name}")
    sure = live.filter("same").select("uid", "at").unionByName(judged.filter("c > 1").select("uid", "at"))
    return sure, judged.filter(F.struct("uid", "at") == F.col("first")).select("uid", "at")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.unhex(F.md5(text)).alias("node"), F.xxhash64("doc_id").alias("r"), text.alias("text")
    )


def repeats(docs: DataFrame) -> DataFrame:
    """``node, n_removed, n_spans, kept, clean`` of each different text that loses bytes.

    ``node`` is the MD5 of the text, ``kept`` the bytes that stay, ``clean`` their whole
    characters. A text with a copy loses all and has a null ``n_removed``.
    """
    keyed = _keyed(docs).filter(F.octet_length("text") >= LENGTH)
    uid = F.monotonically_increasing_id()
    nodes = cut_lineage(
        keyed.groupBy("node").agg(F.min("r").alias("r"), F.count("*").alias("copies")).withColumn("uid", uid)
    )
    # Once each, and in buckets: the two later visits to the texts then move only small rows.
    once = Window.partitionBy("node", "r").orderBy(F.lit(0))
    single = keyed.join(nodes.hint("merge"), ["node", "r"]).withColumn("_n", F.row_number().over(once))
    texts = bucketed(single.filter("_n = 1").select("node", "r", "uid", "text"), "texts", ["node", "r"])
    anchors = stored(
        texts.select("uid", "text").mapInPandas(_find_anchors, "uid long, at long, rank long, stretch long"),
        "anchors",
    )
    places = nodes.select("uid", "node", "r")

    def visited(rows: DataFrame, of, names: list[str], name: str) -> DataFrame:
        lists = rows.groupBy("uid").agg(F.collect_list("at").alias("at")).join(places.hint("merge"), "uid")
        found = texts.join(lists.drop("uid").hint("merge"), ["node", "r"]).select("uid", "text", "at")
        schema = ", ".join(f"{c} long" for c in ["uid", *names])
        return stored(found.mapInPandas(_visit(of, names), schema), name)

    whole, open_ = settled(anchors, ["rank"], "anchors")
    runs = visited(open_, Anchors.runs, ["at", "rank", "core", "stretch"], "runs")
    keyed_runs = runs.withColumn("run", F.col("at") % RUNS)
    sure_runs, open_runs = settled(keyed_runs, ["rank", "run", "core"], "runs")
    windows = visited(open_runs, Anchors.windows, ["start", "rank", "window"], "windows")
    again = windows.groupBy("rank", "window").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    starts = windows.join(again.hint("merge"), ["rank", "window"])
    # Last visit: cut.
    found = [whole.select("uid", "at"), sure_runs.select("uid", "at"), starts.select("uid", F.col("start").alias("at"))]
    marks = functools.reduce(
        DataFrame.unionByName, [x.withColumn("kind", F.lit(k)) for k, x in enumerate(found)]
    )
    losses = (
        marks.groupBy("uid")
        .agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("at"))).alias(c) for k, c in enumerate(("at", "runs", "starts"))])
        .join(nodes.filter("copies = 1").select("uid", "node", "r").hint("merge"), "uid")
    )
    cut = (
        texts.join(losses.drop("uid").hint("merge"), ["node", "r"])
        .select("node", "text", "at", "runs", "starts")
        .mapInPandas(_cut, "node binary, n_removed long, n_spans long, kept binary, clean string")
    )
    lost = nodes.filter("copies > 1").select(
        "node", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.lit(b"").alias("kept"), F.lit("").alias("clean"),
    )
    return cut.unionByName(lost)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", F.unhex(F.md5(text)).alias("node"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text, 256).alias("whole"),
    )
    found = repeats(docs).select(
        "node", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")
    )
    return rows.join(found.hint("merge"), "node", "left").select(
        "doc_id",
        "n_bytes",
        F.when(F.col("sha").isNull(), 0).otherwise(F.coalesce("n_removed", "n_bytes")).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated bytes removed; same columns, ``n_chars`` follows.

    A character that is cut in two is dropped with the removed part.
    """
    packed = docs.select(F.struct("*").alias("_doc"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"))
    joined = packed.join(repeats(docs).select("node", "clean").hint("merge"), "node", "left")
    clean = F.coalesce("clean", F.col("_doc.text"))
    new = {"text": clean}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(F.coalesce(clean, F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])
