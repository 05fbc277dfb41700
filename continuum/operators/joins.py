"""Joins against sets whose size is not known beforehand.

A set too large to be broadcast meets the rows by a sort-merge join on its keys. Rows with texts
would move for that, unless their table is bucketed by the key (``sources.corpus.write_bucketed_corpus``):
then only the keys move.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when it was measured and holds no more rows and bytes than this.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20


def small_or_shuffled(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if a bounded look at it proves it small, else unchanged.

    The look ends at ``max_rows + 1`` rows and adds up the lengths of their values. Use it for
    narrow key sets only.
    """
    size = functools.reduce(
        Column.__add__, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns]
    )
    n, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def anti_join(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``keys``; no shuffle of ``df`` for a small set."""
    return df.join(small_or_shuffled(keys), on, "left_anti")


def semi_join(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``; no shuffle of ``df`` for a small set."""
    return df.join(small_or_shuffled(keys), on, "left_semi")
