"""Global order without a single-task window: numbering, contiguous shards, first N."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from continuum.sources.shared import cut_lineage

if TYPE_CHECKING:
    from continuum.sources.index import StoryIndex

_TOP_IDS = 100_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def with_global_index(keys: DataFrame, order_by: list[str], name: str = "idx") -> DataFrame:
    """Number rows 0, 1, 2, ... in the given order, and add the row total as ``n_rows``.

    A distributed sort gives each partition one stretch of the order. The sorted keys are
    checkpointed, so a later recomputation cannot move a row to another stretch. Only one
    row per partition then meets in one place, to turn partition sizes into offsets. Pass
    key columns only, not texts.
    """
    mid = F.monotonically_increasing_id()
    ranged = cut_lineage(keys.sort(*order_by).withColumn("_mid", mid))
    ranged = ranged.withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(everything).alias("n_rows"),
    )
    in_part = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # offsets: one row per sort partition, so its size is bounded by the shuffle width
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + in_part)
        .drop("_mid", "_part", "_offset")
    )


def shard_number(idx: Column, n_rows: Column, n_shards: int) -> Column:
    """Contiguous shard of a row number; the first ``n_rows mod n_shards`` get one extra row."""
    base = F.floor(n_rows / n_shards)
    extra = n_rows % n_shards
    wide = extra * (base + 1)
    small = F.floor((idx - wide) / F.greatest(base, F.lit(1)))
    return F.when(idx < wide, F.floor(idx / (base + 1))).otherwise(extra + small).cast("int")


def shard_edges(n_rows: int, n_shards: int) -> list[int]:
    """First row of each shard, and the end of the last one: the plain form of ``shard_number``."""
    base, extra = divmod(n_rows, n_shards)
    return [i * base + min(i, extra) for i in range(n_shards + 1)]


def with_shard(stories: DataFrame, n_shards: int) -> DataFrame:
    """``(story_id, shard_id)`` for every story."""
    numbered = with_global_index(stories.select("story_id"), ["story_id"])
    shard = shard_number(F.col("idx"), F.col("n_rows"), n_shards)
    return numbered.select("story_id", shard.alias("shard_id"))


def shard_bounds(stories: DataFrame, n_shards: int) -> DataFrame:
    """``(shard_id, n_stories, first_id, last_id)``: at most ``n_shards`` rows."""
    return (
        with_shard(stories, n_shards)
        .groupBy("shard_id")
        .agg(
            F.count("*").alias("n_stories"),
            F.min("story_id").alias("first_id"),
            F.max("story_id").alias("last_id"),
        )
    )


def _between(stories: DataFrame, ends: tuple[str, str] | None) -> DataFrame:
    return stories.filter(F.lit(False) if ends is None else F.col("story_id").between(*ends))


def indexed_slice(
    stories: DataFrame, index: StoryIndex, shard_id: int = 0, n_shards: int = 1, first: int = 0
) -> DataFrame:
    """A shard, and of it the first N stories (0: all), by the stored index: no job reads the corpus.

    ``stories`` are those the index was made of, or the discovered ones among them.
    """
    low, count = index.shard_rows(shard_id, n_shards)
    return _between(stories, index.range_of(low, min(count, first) if first > 0 else count))


def slice_by(stories: DataFrame, ids: DataFrame, shard_id: int, n_shards: int, first: int) -> DataFrame:
    """A shard of ``ids(story_id)``, and of it the first N (0: all), as an id range on ``stories``."""
    low = high = None
    if n_shards > 1:
        bounds = shard_bounds(ids, n_shards).filter(F.col("shard_id") == shard_id).first()
        if bounds is None:
            return _between(stories, None)
        low, high = bounds["first_id"], bounds["last_id"]
        ids, stories = _between(ids, (low, high)), _between(stories, (low, high))
    if first <= 0:
        return stories
    last = _last_of_first(ids, first)
    return _between(stories, None) if last is None else stories.filter(F.col("story_id") <= last)


def shard(stories: DataFrame, shard_id: int, n_shards: int) -> DataFrame:
    """The stories of one shard.

    A shard is contiguous in id order, hence an id range. Two ids travel to the driver and
    come back as a range filter, which a columnar source can prune by. Empty shard: no rows.
    Numbering reads the ids; with many shards, write an index once and use ``indexed_slice``.
    """
    return slice_by(stories, stories, shard_id, n_shards, 0)


def first_n(stories: DataFrame, n: int) -> DataFrame:
    """The first n stories by id; 0 means all.

    The n-th id is found on the id column alone and used as a filter, so no text is sorted.
    """
    return slice_by(stories, stories, 0, 1, n)


def _last_of_first(ids: DataFrame, n: int) -> str | None:
    ids = ids.select("story_id")
    if n <= _TOP_IDS:
        head = ids.orderBy("story_id").limit(n)
    else:  # too many ids for one task: number them all instead
        head = with_global_index(ids, ["story_id"]).filter(F.col("idx") < n)
    return head.agg(F.max("story_id")).first()[0]
