"""Counts along the way: the filter funnel and the progress of each run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuum.config import CURRENT, StudyConfig
from continuum.operators.ordering import shard_bounds
from continuum.operators.sentences import with_sentences
from continuum.sources.catalogue import RUNS, Run, fan_out
from continuum.sources.index import StoryIndex, story_flags
from continuum.sources.shared import cut_lineage


_STAGES = ("scanned", "in_id_range", "discovered", "long_enough", "too_short")


def funnel_counts(
    stories: DataFrame,
    config: StudyConfig = CURRENT,
    *,
    id_filter: bool = True,
    n_shards: int = 0,
) -> DataFrame:
    """``(stage, n, first_id, last_id)`` after each filter, from one pass over the corpus.

    ``n_shards`` adds one row per shard of the discovered stories; ids and flags are then kept
    once, so that neither the sort nor the counts read a text again.
    """
    flags = story_flags(stories, config, id_filter=id_filter)
    if n_shards > 0:
        flags = cut_lineage(flags)
        return funnel_of(flags).unionByName(_shard_stages(shard_bounds(flags.filter("discovered"), n_shards)))
    return funnel_of(flags)


def indexed_funnel(index: StoryIndex, n_shards: int = 0) -> DataFrame:
    """``funnel_counts`` from a stored index; the corpus is not read."""
    funnel = funnel_of(index.flags)
    return funnel.unionByName(_shard_stages(index.shard_bounds(n_shards))) if n_shards > 0 else funnel


def funnel_of(flags: DataFrame) -> DataFrame:
    """``(stage, n, first_id, last_id)`` of stories with flags."""
    short = F.col("discovered") & ~F.col("long_enough")
    conditions = {**{s: F.col(s) for s in _STAGES[1:4]}, "scanned": F.lit(True), "too_short": short}
    counts = flags.agg(*[_stage(conditions[name]).alias(name) for name in _STAGES])
    return counts.select(F.inline(F.array(*[_row(s) for s in _STAGES])))


def _shard_stages(bounds: DataFrame) -> DataFrame:
    stage = F.concat(F.lit("shard_"), F.col("shard_id").cast("string")).alias("stage")
    return bounds.select(stage, F.col("n_stories").alias("n"), "first_id", "last_id")


def _stage(condition: Column) -> Column:
    hit = F.when(condition, F.col("story_id"))
    return F.struct(F.count(hit).alias("n"), F.min(hit).alias("first_id"), F.max(hit).alias("last_id"))


def _row(stage: str) -> Column:
    c = F.col(stage)
    return F.struct(
        F.lit(stage).alias("stage"),
        c["n"].alias("n"),
        c["first_id"].alias("first_id"),
        c["last_id"].alias("last_id"),
    )


def done_runs(done: DataFrame) -> DataFrame:
    """``(story_id, runs array<string>)``: at most one entry per run of the catalogue."""
    return done.groupBy("story_id").agg(F.collect_set("run").alias("done_runs"))


def progress_counts(
    stories: DataFrame, done: DataFrame, runs: Sequence[Run] = RUNS, config: StudyConfig = CURRENT
) -> DataFrame:
    """``(run, n_processed, n_skipped, n_too_short)`` of a pass over ``stories``.

    A story already done is skipped whatever its length; one that is too short is neither
    processed nor skipped. Texts shrink to a sentence count before the join, so none is shuffled.
    """
    sized = with_sentences(stories).select("story_id", F.size("sentences").alias("n_sentences"))
    known = sized.join(done_runs(done), "story_id", "left")
    is_done = F.coalesce(F.array_contains("done_runs", F.col("run")), F.lit(False))
    is_short = F.col("n_sentences") < config.min_sentences
    return (
        fan_out(known, ["run"], runs)
        .groupBy("run")
        .agg(
            F.count(F.when(~is_done & ~is_short, 1)).alias("n_processed"),
            F.count(F.when(is_done, 1)).alias("n_skipped"),
            F.count(F.when(~is_done & is_short, 1)).alias("n_too_short"),
        )
    )
