"""Arrays of counts in binary columns: packed, dealt into slices, and added up without large groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

TABLE = "slice int, counts binary"
LOT = 64  # tasks whose tables are added up in one group


def packed(x: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as compressed planes of bytes."""
    data = np.ascontiguousarray(x.astype(kind)).view(np.uint8)
    return zstandard.compress(data.reshape(len(x), np.dtype(kind).itemsize).T.tobytes(), 3)


def unpacked(data: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(x: np.ndarray) -> np.ndarray:
    """Ascending numbers as their differences."""
    return np.diff(x, prepend=0)


def slices(table: np.ndarray, n: int) -> pd.DataFrame:
    """A table of counts as ``n`` rows of ``TABLE``."""
    rows = [(i, packed(x, "<i8")) for i, x in enumerate(np.array_split(table, n))]
    return pd.DataFrame(rows, columns=["slice", "counts"])


def added(tables: DataFrame, n_slices: int) -> np.ndarray:
    """The sum of tables of counts, which come as ``slices``: by task, by groups of tasks, in all.

    What reaches the driver is one table. No tables give an empty array.
    """

    def in_task(batches):
        lot = TaskContext.get().partitionId() // LOT
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch["slice"], batch["counts"], strict=True):
                x = unpacked(counts, "<i8")
                total[i] = total[i] + x if i in total else x
        rows = [(i, lot, packed(x, "<i8")) for i, x in total.items()]
        yield pd.DataFrame(rows, columns=["slice", "lot", "counts"])

    def together(key, rows: pd.DataFrame) -> pd.DataFrame:
        total = unpacked(rows["counts"].iloc[0], "<i8").copy()
        for x in rows["counts"].iloc[1:]:
            total += unpacked(x, "<i8")
        return pd.DataFrame({"slice": [key[0]], "counts": [packed(total, "<i8")]})

    lots = tables.mapInPandas(in_task, "slice int, lot int, counts binary")
    once = lots.groupBy("slice", "lot").applyInPandas(together, TABLE)
    found = dict(once.groupBy("slice").applyInPandas(together, TABLE).collect())
    return np.concatenate([unpacked(found[i], "<i8") for i in range(n_slices)]) if found else np.empty(0, np.int64)
