"""Homomorphic multiset fingerprints of paragraphs.

A paragraph (a line, empty ones included) is hashed to a wide vector, and a text's fingerprint
is the sum of its paragraphs' vectors, lane by lane, modulo a power of two. So the order of
paragraphs does not matter, adding or removing one is adding or subtracting its vector, and
texts with equal paragraphs have equal fingerprints.

The vector has two parts. 32 lanes modulo 2**32 are uniform hashes of the whole paragraph: they
tell different multisets apart. 256 lanes modulo 2**32 count the paragraph's eight-byte strings
with hashed signs: their inner product estimates how much two texts share, whatever their
paragraphs.

``likeness`` is the inner product of the counting lanes over the larger of their squared norms,
held to 0..1, and 1 for equal fingerprints.

Defined results: a null text is empty, which is one empty paragraph; rows with equal ids follow
each other by the MD5 of their texts, equal rows count once in that order and each has a result;
ids are numbers and null ids come first; the only row of a table is its own next; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from continuum.llm import words

HASH_LANES = 32
COUNT_LANES = 256
GRAM = 8
_STEPS = np.array([words.multiple(2 * k + 1) for k in range(HASH_LANES)])


def _grams(data: bytes) -> np.ndarray:
    """The eight-byte strings of a text that hold no line break, as 64-bit numbers."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for k in range(min(GRAM, n)):
        out[k::GRAM] = np.frombuffer(data, "<u8", (len(data) - k) // GRAM, k)
    breaks = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) == 10)])
    return out[breaks[GRAM:] == breaks[:-GRAM]]


def fingerprint(text: str) -> bytes:
    """The sum of the vectors of all paragraphs, as little-endian lanes."""
    data = text.encode("utf-8", "replace")
    paragraphs = data.split(b"\n")
    names = np.array([xxhash.xxh3_64_intdigest(p) for p in paragraphs], np.uint64)
    lanes = words.mix(names[:, None] + _STEPS[None, :]).astype(np.uint32).sum(axis=0, dtype=np.uint32)
    short = [xxhash.xxh3_64_intdigest(p) for p in paragraphs if 0 < len(p) < GRAM]
    hits = words.mix(np.concatenate([_grams(data), np.array(short, np.uint64)]))
    where = (hits & np.uint64(2 * COUNT_LANES - 1)).astype(np.int64)
    counts = np.bincount(where, minlength=2 * COUNT_LANES)
    signed = counts[:COUNT_LANES] - counts[COUNT_LANES:]
    return lanes.astype("<u4").tobytes() + signed.astype("<i4").tobytes()


def added(a: bytes, b: bytes, sign: int = 1) -> bytes:
    """The fingerprint of ``a`` with the paragraphs of ``b`` put in (or, with -1, taken out)."""
    cut = 4 * HASH_LANES
    hashes = np.frombuffer(a[:cut], "<u4") + np.uint32(sign % 2**32) * np.frombuffer(b[:cut], "<u4")
    counts = np.frombuffer(a[cut:], "<i4") + np.int32(sign) * np.frombuffer(b[cut:], "<i4")
    return hashes.astype("<u4").tobytes() + counts.astype("<i4").tobytes()


def likeness(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Estimated share in common of each pair of fingerprints, 0 to 1."""
    cut = 4 * HASH_LANES
    x, y = (
        np.frombuffer(b"".join(f[cut:] for f in side), "<i4").reshape(-1, COUNT_LANES).astype(float)
        for side in (a, b)
    )
    if not len(x):
        return np.empty(0)
    norm = np.maximum((x * x).sum(axis=1), (y * y).sum(axis=1))
    share = np.clip((x * y).sum(axis=1) / np.where(norm == 0, 1, norm), 0, 1)
    return np.where([p == q for p, q in zip(a, b, strict=True)], 1.0, share)


class Chain:
    """Reads texts in order and gives each its results once the next one is known."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.state = None
        self.keys: list = []
        self.text = self.print = None

    def add(self, group: int, tail: bool, key, digest: bytes, text: str) -> None:
        state = (group, tail, key, digest)
        if state == self.state:
            self.keys.append(key)
            return
        now = fingerprint(text)
        if self.state and self.state[0] == group and not self.state[1]:
            room = len(self.text) // 2
            edited = self.text[: len(self.text) - room] + text[:room]
            result = (
                len(self.text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(),
                self.print, fingerprint(edited), now,
            )
            self.rows += [(k, *result) for k in self.keys]
        self.state, self.keys, self.text, self.print = state, [key], text, now

    def taken(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        key, n, sha, own, changed, following = (list(x) for x in zip(*rows, strict=True))
        return pd.DataFrame(
            {
                "key": key,
                "n_chars": n,
                "edited_sha256": sha,
                "fingerprint": [base64.b64encode(p).decode() for p in own],
                "edited_fingerprint": [base64.b64encode(p).decode() for p in changed],
                "near_edited": likeness(own, changed),
                "near_next": likeness(own, following),
            }
        )


def _walk(batches):
    chain = Chain()
    for batch in batches:
        for row in zip(*(batch[c] for c in ("group", "tail", "key", "digest", "text")), strict=True):
            chain.add(*row)
        if chain.rows:
            yield chain.taken()


def _range_of(bounds: list):
    """The number of the range an id without nulls falls into, by the least ids of the ranges."""

    @F.pandas_udf(IntegerType())
    def range_of(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(np.array(bounds), ids.to_numpy(), side="right") if bounds else np.zeros(len(ids))
        return pd.Series(np.maximum(at - 1, 0).astype(np.int32))

    return range_of


def _ranges(docs: DataFrame, n: int) -> list:
    """The least ids of at most ``n`` ranges of about equal numbers of rows, ascending."""
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL")
    shares = [k / n for k in range(n)]
    about = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 100 * n))).first()[0]
    parts = ids.groupBy(_range_of(sorted(set(about or [])))("doc_id")).agg(F.min("doc_id"))
    return sorted(row[1] for row in parts.collect())


def with_edits(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next row.

    The last half of the edited text is the beginning of the next row's text. Rows are dealt
    into ranges of ids and walked through in order; the first rows of a range go to the one
    before as well, where they end the walk, so each text moves once.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType
    bounds = _ranges(docs, 4 * n)
    last = max(len(bounds) - 1, 0)

    text = F.coalesce("text", F.lit(""))
    starts = F.array(*[F.lit(x) for x in bounds]).cast(f"array<{kind.simpleString()}>")
    filled = F.coalesce("doc_id", F.lit(bounds[0] if bounds else None).cast(kind))
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("digest"), _range_of(bounds)(filled).alias("group"))
    # Null ids come first, so where there are any, they and not the least id follow the last row.
    heads = docs.filter("doc_id IS NULL").limit(1).count()
    leads = F.coalesce(F.get(starts, F.col("group")) == F.col("doc_id"), F.lit(False))
    wraps = F.col("doc_id").isNull() if heads else leads & (F.col("group") == 0)
    own = F.struct(F.col("group"), F.lit(False).alias("tail"))
    to_last = F.struct(F.lit(last).alias("group"), F.lit(True).alias("tail"))
    before = F.struct((F.col("group") - 1).alias("group"), F.lit(True).alias("tail"))
    copies = F.when(wraps, F.array(own, to_last)).when(leads & (F.col("group") > 0), F.array(own, before)).otherwise(F.array(own))
    dealt = rows.withColumn("to", F.explode(copies)).select("to.group", "to.tail", "doc_id", "digest", "text")
    ordered = dealt.repartition(n, "group").sortWithinPartitions("group", "tail", "doc_id", "digest")
    # Ids travel as text: in pandas, a null beside them would turn large numbers into floats.
    walked = ordered.select("group", "tail", F.col("doc_id").cast("string").alias("key"), "digest", "text")
    schema = (
        "key string, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return walked.mapInPandas(_walk, schema).select(
        F.col("key").cast(kind).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
