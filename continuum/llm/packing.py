"""Best-fit packing by sums of squares.

A document is its token ids and one end id. One longer than a sequence is cut into pieces of a
whole sequence, the first piece taking what is left over. A piece goes where the sum, over all
residual gaps, of the squared number of open sequences with that gap becomes smallest; equal
choices go to the tightest gap. Longest pieces come first, and a new sequence is opened only
where no open one has room.

Pieces are dealt at random into groups of about ``GROUP`` pieces, and each group is packed by
itself, so no task sees more than a group, whatever the size of the table or of one key. What
this costs is at most a few part-filled sequences per group of many thousand.

Defined results: null text is empty and gives one piece of one id; repeated rows are packed as
often as they occur; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuum.llm import tokens
from continuum.llm.words import lots
from continuum.sources.shared import cut_lineage

BUDGET = 2048
END_ID = 0
GROUP = 1 << 15
PIECES = "key string, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, budget: int = BUDGET, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids``: the ids are 32-bit little-endian bytes."""
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoder(vocabulary)
        for batch in lots(batches):
            rows = []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                ids = encoder.ids(text or "") + end
                n = len(ids) // 4
                stop = n if n <= budget else n % budget or budget
                start = number = 0
                while start < n:
                    rows.append((key, number, start, stop - start, ids[4 * start : 4 * stop]))
                    start, stop, number = stop, stop + budget, number + 1
            yield pd.DataFrame(rows, columns=["key", "piece", "start", "length", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # Ids travel as text: in pandas, a null beside them would turn large numbers into floats.
    texts = docs.select(F.col("doc_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(cut, PIECES).select(
        F.col("key").cast(kind).alias("doc_id"), "piece", "start", "length", "ids"
    )


def fill(lengths: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece, by the sum-of-squares rule, longest first.

    A new bin is opened only where no open one has room.
    """
    where = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    counts = np.zeros(budget + 1, np.int64)  # open bins by gap; full bins are not counted
    open_bins: list[list[int]] = [[] for _ in range(budget + 1)]
    n_bins = 0
    for item in np.argsort(-lengths, kind="stable"):
        size = int(lengths[item])
        gaps = size + np.flatnonzero(counts[size:])
        if len(gaps):
            # Moving a bin from gap g to g - size changes the sum by 2 (N[g-size] - N[g]) + 2,
            # one less where the bin becomes full.
            change = 2 * (counts[gaps - size] - counts[gaps]) + (gaps > size)
            gap = int(gaps[change.argmin()])
            number = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, number, n_bins = budget, n_bins, n_bins + 1
        where[item], offset[item] = number, budget - gap
        if gap > size:
            open_bins[gap - size].append(number)
            counts[gap - size] += 1
    return where, offset


def placed(items: DataFrame, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table with a ``length``, in place of such columns.

    The rows are checkpointed first, so that a lost executor cannot deal them differently.
    """
    items = items.drop("sequence_id", "offset", "_group")
    numbered = cut_lineage(items.withColumn("_group", F.monotonically_increasing_id()))
    n_groups = max(1, -(-numbered.count() // group))
    dealt = numbered.withColumn("_group", F.pmod(F.xxhash64("_group"), F.lit(n_groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)

    def pack(rows: pa.Table) -> pa.Table:
        where, offset = fill(rows["length"].to_numpy().astype(np.int64), budget)
        number = (np.int64(rows["_group"][0].as_py()) << 32) + where
        rows = rows.drop_columns(["_group"]).append_column("sequence_id", pa.array(number))
        return rows.append_column("offset", pa.array(offset))

    return dealt.groupBy("_group").applyInArrow(pack, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, n_ids, documents`` from placed pieces that carry their ids.

    A sequence has at most a budget of ids, so a group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_ids"),
        F.transform("parts", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"])).alias(
            "documents"
        ),
    )
