"""Lower-case terms of a text as bytes: runs of digits, letters and characters beyond ASCII."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every byte to itself, A-Z to a-z, and any other ASCII character to a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def folded(data: bytes) -> list[bytes]:
    """The terms of UTF-8 text in order; only A-Z are lower-cased."""
    return data.translate(_FOLD).split()


def utf8(text: Column) -> Column:
    """The bytes of a text; a null text is empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def item_blocks(items: DataFrame, limit: int, overlap: int = 0) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """``items(item_id, text)`` as blocks of ``(id, terms)`` whose terms have about ``limit`` bytes.

    The driver holds one block at a time. With ``overlap``, an item longer than a block is cut into
    parts that share that many terms; without, it stays whole.
    """
    block: list[tuple[str | None, list[bytes]]] = []
    load = 0
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), utf8(F.col("text")).alias("text"))
    for row in rows.toLocalIterator():
        for part in _parts(folded(bytes(row["text"])), limit, overlap):
            block.append((row["item_id"], part))
            load += sum(map(len, part)) + len(part)
            if load >= limit:
                yield block
                block, load = [], 0
    if block:
        yield block


def _parts(terms: list[bytes], limit: int, overlap: int) -> Iterable[list[bytes]]:
    if not overlap:
        yield terms
        return
    first = load = 0
    for i, term in enumerate(terms):
        load += len(term) + 1
        if load >= limit and i - first >= 2 * overlap:
            yield terms[first : i + 1]
            first, load = i + 1 - overlap, 0
    if first == 0 or len(terms) - first > overlap:
        yield terms[first:]
