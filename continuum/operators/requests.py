"""Generation requests: positions x runs, with budgets and the context guard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from continuum.config import CURRENT, StudyConfig
from continuum.functions import study
from continuum.operators.prompts import prompt_words
from continuum.sources.catalogue import MODELS, RUNS, Model, Run, fan_out

RUN_FIELDS = [
    "run_no", "run", "model", "prompt_mode", "is_reasoning", "enable_thinking", "strip_think", "max_tokens_mult",
]
KEYS = ["run", "story_id", "position"]
TOKEN_COUNTS = "token_counts"
LOT = "lot"


def by_lot(*tables: DataFrame) -> list[str]:
    """``["lot"]`` if all tables have that column, to be put before their keys.

    A story, its requests and its completions may carry the number of the lot the story was dealt to. Tables
    that lie in equally many partitions by lot (``deal``) meet where they are: the joins and groups of this
    library name the lot among their keys, so Spark moves no row for them, whatever its texts.
    """
    return [LOT] if all(LOT in t.columns for t in tables) else []


def lot_keys(*tables: DataFrame) -> list[str]:
    """The keys of a request; by lot, story and cut first where there are lots, as one sort then serves those too."""
    return [LOT, "story_id", "position", "run"] if by_lot(*tables) else KEYS


def deal(rows: DataFrame, partitions: int | None) -> DataFrame:
    """Rows in so many partitions by lot; None leaves them where they are.

    Lots that are ``int`` are numbers of partitions (modulo their count), so lots as even as they are give even
    partitions; others are hashed.
    By default Spark takes tables for a join as lying right only if they lie by all keys of the join. The session
    is told here that the lot, one of the keys, is enough, and that sorted rows are grouped as they go by.
    """
    if partitions is None:
        return rows
    rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    rows.sparkSession.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")
    numbered = dict(rows.dtypes)[LOT] == "int"
    return rows.repartitionById(partitions, LOT) if numbered else rows.repartition(partitions, LOT)


def groups_in_order(spark: SparkSession) -> bool:
    """Whether the session groups sorted rows as they go by, as ``deal`` tells it to."""
    return spark.conf.get("spark.sql.execution.replaceHashWithSortAgg", "false") == "true"


def with_token_counts(rows: DataFrame, counts: DataFrame | None) -> DataFrame:
    """``rows`` with a map of the counts that a tokenizer gave for a story's prompts, if there are any.

    ``counts (run, story_id, position, prompt_tokens)`` becomes one map per story, of runs x cuts
    entries at most, so requests, exported prompts and records are guarded by the same numbers. Of
    several counts for one prompt the largest is taken.
    """
    if counts is None:
        return rows
    lot = by_lot(rows, counts)
    single = counts.groupBy(*lot, *KEYS).agg(F.max("prompt_tokens").cast("int").alias("tokens"))
    entry = F.struct(F.struct("run", F.col("position").cast("int").alias("position")), "tokens")
    maps = single.groupBy(*lot, "story_id").agg(F.map_from_entries(F.collect_list(entry)).alias(TOKEN_COUNTS))
    return rows.join(maps.hint("merge"), [*lot, "story_id"], "left")


def prompt_tokens(position: Column, prefix_words: Column, config: StudyConfig, counted: bool) -> Column:
    """Tokens of a prompt of the row's run: the supplied count, or else the estimate."""
    estimate = study.estimated_tokens(prompt_words(prefix_words, F.col("prompt_mode")), config)
    if not counted:
        return estimate
    key = F.struct(F.col("run").alias("run"), position.alias("position"))
    return F.coalesce(F.try_element_at(F.col(TOKEN_COUNTS), key), estimate)


def token_budgets(positions: DataFrame, config: StudyConfig = CURRENT) -> DataFrame:
    """Budget of each cut in both modes: plain at the default multiplier, thinking at 2.0."""
    w = F.col("target_n_words")
    modes = [(False, config.buffer_mult), (True, 2.0)]
    per_mode = F.array(
        *[
            F.struct(
                F.lit(thinking).alias("thinking"),
                study.token_budget(w, F.lit(mult), F.lit(thinking), config).alias("max_tokens"),
            )
            for thinking, mult in modes
        ]
    )
    return positions.select("story_id", "position", F.inline(per_mode))


def requests(
    positions: DataFrame,
    runs: Sequence[Run] = RUNS,
    registry: Sequence[Model] = MODELS,
    config: StudyConfig = CURRENT,
    *,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Every cut for every run, before the context guard. Keys, flags and numbers only, and
    the columns to ``keep``.

    A ``token_counts`` column of the positions (``with_token_counts``) goes before the estimate.
    """
    counted = TOKEN_COUNTS in positions.columns
    rows = fan_out(positions, RUN_FIELDS, runs, registry)
    return rows.select(
        *by_lot(positions),
        *RUN_FIELDS,
        "story_id",
        "position",
        "target_n_words",
        study.token_budget(
            F.col("target_n_words"), F.col("max_tokens_mult"), F.col("strip_think"), config
        ).alias("max_tokens"),
        prompt_tokens(F.col("position"), F.col("prefix_words"), config, counted).alias("prompt_tokens_est"),
        F.lit(config.n_continuations).alias("n_continuations"),
        F.lit(config.temperature).alias("temperature"),
        F.lit(config.top_p).alias("top_p"),
        *keep,
    )


def fits_context(prompt_tokens: Column, max_tokens: Column, config: StudyConfig = CURRENT) -> Column:
    return prompt_tokens + max_tokens <= config.context_length


def context_guard(requests: DataFrame, config: StudyConfig = CURRENT) -> DataFrame:
    """Drop requests whose prompt and budget together exceed the context window."""
    return requests.filter(fits_context(F.col("prompt_tokens_est"), F.col("max_tokens"), config))
