"""Aligning runs on the same story and cut: pairs and chains of stages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuum.config import StudyConfig
from continuum.operators.completions import gather_samples
from continuum.operators.requests import by_lot, groups_in_order
from continuum.sources.catalogue import COMPARISON_GROUPS, RUNS, GroupMember, Run, group_members

PAIR_SIDES = ("left", "right")
STAGE_SIDES = ("base", "sft", "dpo", "final")


def align(
    cleaned: DataFrame,
    kind: str,
    sides: Sequence[str],
    config: StudyConfig,
    members: Sequence[GroupMember] = COMPARISON_GROUPS,
    runs: Sequence[Run] = RUNS,
) -> DataFrame:
    """``(group_id, story_id, position, <side> array<string>...)`` where every side is present.

    ``cleaned`` holds one row per sample; ``config`` tells how many a request has. Deliveries fold per request first; one more
    aggregation over at most one row per cut and member replaces a self-join per side. The group table is
    configuration and broadcast.
    """
    numbers = {m.run_no for m in members if m.kind == kind}
    compared = [r.run for r in runs if r.run_no in numbers]
    groups = group_members(cleaned.sparkSession, kind, members, runs)
    # The filter reaches the scan, so texts of other runs are neither read nor cleaned.
    answers = gather_samples(
        cleaned.filter(F.col("run").isin(compared)),
        config.n_continuations,
        by=["story_id", "position"],
        usual=len(compared) * config.n_continuations,
    )
    cut, members_of = [*by_lot(cleaned), "story_id", "position"], answers.join(groups, "run")
    # A cut's answers are in one place and in order: nothing is sorted again for its groups.
    if by_lot(cleaned) and groups_in_order(cleaned.sparkSession):
        members_of = members_of.sortWithinPartitions(*cut)
    bags = members_of.groupBy(*cut).agg(F.collect_list(F.struct("group_id", "ord", "samples")).alias("bag"))
    per_group = F.transform(
        F.array_distinct("bag.group_id"),
        lambda g: F.struct(
            g.alias("group_id"), *[_side(g, i).alias(side) for i, side in enumerate(sides, start=1)]
        ),
    )
    aligned = bags.select("story_id", "position", F.inline(per_group)).select("group_id", "story_id", "position", *sides)
    present = [F.size(side) > 0 for side in sides]
    return aligned.filter(reduce(Column.__and__, present))


def _side(group: Column, ord_: int) -> Column:
    mine = F.filter("bag", lambda b: (b["group_id"] == group) & (b["ord"] == ord_))
    return F.flatten(F.transform(mine, lambda b: b["samples"]["continuation"]))


def compare_pairs(cleaned: DataFrame, config: StudyConfig, **tables) -> DataFrame:
    """Base against instruct, thinking off against on."""
    return align(cleaned, "pair", PAIR_SIDES, config, **tables)


def compare_stages(cleaned: DataFrame, config: StudyConfig, **tables) -> DataFrame:
    """The two chains base, SFT, DPO, final."""
    return align(cleaned, "stages", STAGE_SIDES, config, **tables)
