"""A stored index of a corpus: what the filters say about each story, and the order of what is left.

Shards, first-N and the funnel need the ids that pass the id range and the word cap, in order.
The index is written from one pass over the corpus and answers all of them afterwards: a shard is
two rows of a table sorted by row number, found by its file statistics, and no text is read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from continuum.config import CURRENT, StudyConfig
from continuum.functions import text
from continuum.operators.filters import id_number
from continuum.operators.ordering import shard_edges, with_global_index
from continuum.operators.sentences import with_sentences

FLAGS = "story_id string, in_id_range boolean, discovered boolean, long_enough boolean"
ORDERED = "idx long, story_id string, n_rows long"
ROWS_PER_FILE = 1_000_000


@dataclass(frozen=True)
class StoryIndex:
    """An index below ``path``; reading it never touches the corpus."""

    spark: SparkSession
    path: str

    @property
    def flags(self) -> DataFrame:
        """``(story_id, in_id_range, discovered, long_enough)`` of every story scanned."""
        return self.spark.read.schema(FLAGS).parquet(f"{self.path}/flags")

    @property
    def ordered(self) -> DataFrame:
        """``(idx, story_id, n_rows)`` of the discovered stories, numbered in order from 0."""
        return self.spark.read.schema(ORDERED).parquet(f"{self.path}/ordered")

    def n_stories(self) -> int:
        row = self.ordered.filter("idx = 0").first()
        return 0 if row is None else row["n_rows"]

    def range_of(self, first: int, count: int) -> tuple[str, str] | None:
        """The least and greatest id of ``count`` stories from row ``first`` on; None if there are none."""
        total = self.n_stories()
        last = min(first + count, total) - 1
        if last < first:
            return None
        ends = self.ordered.filter(F.col("idx").isin(first, last)).select("idx", "story_id").collect()
        ids = {r["idx"]: r["story_id"] for r in ends}
        return ids[first], ids[last]

    def shard_rows(self, shard_id: int, n_shards: int) -> tuple[int, int]:
        """First row and number of rows of a shard."""
        first, after = shard_edges(self.n_stories(), n_shards)[shard_id : shard_id + 2]
        return first, after - first

    def shard_bounds(self, n_shards: int) -> DataFrame:
        """``(shard_id, n_stories, first_id, last_id)`` of the shards that hold stories."""
        edges = shard_edges(self.n_stories(), n_shards)
        spans = [(i, b - a, a, b - 1) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        wanted = self.spark.createDataFrame(spans, "shard_id int, n_stories long, first long, last long")
        ends = self.ordered.filter(F.col("idx").isin(sorted({x for s in spans for x in s[2:]})))
        named = ends.select("idx", "story_id")
        # One row per shard: the caller's number bounds what is broadcast.
        low = wanted.join(F.broadcast(named.toDF("first", "first_id")), "first")
        return low.join(F.broadcast(named.toDF("last", "last_id")), "last").select(
            "shard_id", "n_stories", "first_id", "last_id"
        )


def story_flags(stories: DataFrame, config: StudyConfig = CURRENT, *, id_filter: bool = True) -> DataFrame:
    """What each filter says about each story; a text is only looked at if the filters before let it pass."""
    number = id_number(F.col("story_id"))
    in_range = (number >= config.min_story_id) & (number < config.max_story_id)
    listed = F.coalesce(in_range, F.lit(False)) if id_filter else F.lit(True)
    found = F.coalesce(F.when(listed, text.at_most_words(F.col("text"), config.max_words)), F.lit(False))
    flags = stories.select("story_id", listed.alias("in_id_range"), found.alias("discovered"), "text")
    split = with_sentences(flags.withColumn("text", F.when(F.col("discovered"), F.col("text"))))
    long_enough = F.coalesce(F.size("sentences") >= config.min_sentences, F.lit(False))
    return split.select("story_id", "in_id_range", "discovered", (F.col("discovered") & long_enough).alias("long_enough"))


def id_flags(stories: DataFrame, config: StudyConfig = CURRENT, *, id_filter: bool = True) -> DataFrame:
    """``story_flags`` where no word cap applies: from the ids alone, no text is read."""
    number = id_number(F.col("story_id"))
    in_range = F.coalesce((number >= config.min_story_id) & (number < config.max_story_id), F.lit(False))
    listed = in_range if id_filter else F.lit(True)
    return stories.select(
        "story_id", listed.alias("in_id_range"), listed.alias("discovered"), F.lit(None).cast("boolean").alias("long_enough")
    )


def write_index(
    stories: DataFrame,
    path: str,
    config: StudyConfig = CURRENT,
    *,
    id_filter: bool = True,
    word_cap: bool = True,
) -> StoryIndex:
    """Write the index of a corpus: one pass over it, and none over its texts without the word cap."""
    index = StoryIndex(stories.sparkSession, path)
    made = (story_flags if word_cap else id_flags)(stories, config, id_filter=id_filter)
    made.write.mode("overwrite").parquet(f"{path}/flags")
    found = index.flags.filter("discovered").select("story_id")
    numbered = with_global_index(found, ["story_id"]).select("idx", "story_id", "n_rows")
    # Rows of a partition are in order, so files and row groups have narrow bounds of idx.
    numbered.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{path}/ordered")
    return index
