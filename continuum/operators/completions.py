"""Joining externally generated texts back to their requests.

Both sides of these joins grow with the corpus, and a planner's estimate does not see how far
an ``explode`` multiplies rows. The joins ask for a sort-merge, so neither side is ever
broadcast on a wrong guess; adaptive execution still splits a skewed partition.

``completions (run, story_id, position, sample_idx, raw_text)`` comes from the generation
engine: one row per sample of a request, and perhaps ``delivery long``, which grows with each
try. A sample may be delivered again. Then one delivery counts, everywhere: one with text before
an empty one, then the latest, then the least in text order, whatever order they came in.
Samples numbered outside ``0..n-1`` are not part of a request; ``checks.check_output_count``
reports them, and repeated and missing ones, and deliveries that nobody asked for. Gathered
samples keep their numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuum.config import CURRENT, StudyConfig
from continuum.functions import text
from continuum.operators import sentences
from continuum.operators.requests import KEYS, by_lot, groups_in_order, lot_keys
from continuum.sources.catalogue import MODELS, RUNS, Model, Run, stripping_runs

CROWDED = 20  # deliveries per sample that are still taken as usual

def clean_completions(
    completions: DataFrame, runs: Sequence[Run] = RUNS, registry: Sequence[Model] = MODELS
) -> DataFrame:
    """Raw text to continuation: reasoning is stripped only where the run asks for it.

    What names a run that is not among ``runs`` is no answer and is left out. Done before any shuffle, so the reasoning, often longer than the answer, never moves.
    """
    delivery = F.col("delivery") if "delivery" in completions.columns else F.lit(None)
    planned = completions.filter(F.col("run").isin([r.run for r in runs]))
    return with_continuation(planned, runs, registry).select(
        *by_lot(completions),
        *KEYS,
        "sample_idx",
        delivery.cast("long").alias("delivery"),
        "continuation",
    )


def with_continuation(
    completions: DataFrame, runs: Sequence[Run] = RUNS, registry: Sequence[Model] = MODELS
) -> DataFrame:
    """Deliveries with ``continuation``: the text without the reasoning, if its run strips it, and without white
    space at its ends. Each step reads a column of its own, so none is computed twice."""
    strips, kept = F.col("run").isin(stripping_runs(runs, registry)), completions.columns
    raw, rest, answer = F.col("raw_text"), F.col("_rest"), F.col("_answer")
    opened = completions.select(*kept, F.when(strips, text.without_blocks(raw)).otherwise(raw).alias("_rest"))
    answers = opened.select(*kept, F.when(strips, text.after_close(rest)).otherwise(rest).alias("_answer"))
    return answers.select(*kept, text.strip(answer).alias("continuation"))


def _preferred(i: int) -> Column:
    """The order of the deliveries of sample ``i``; the least counts."""
    latest_first = F.coalesce(-F.col("delivery"), F.lit((1 << 63) - 1))
    rank = F.struct(
        (F.col("continuation") == "").alias("empty"), latest_first.alias("age"), F.col("continuation").alias("text")
    )
    return F.when((F.col("sample_idx") == i) & F.col("continuation").isNotNull(), rank)


def crowded(cleaned: DataFrame, by: Sequence[str], usual: int) -> bool:
    """Whether some group of ``by`` has far more rows than ``usual``; reads and moves keys only."""
    most = cleaned.groupBy(*by).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0]
    return (most or 0) > CROWDED * usual


def gather_samples(
    cleaned: DataFrame, n: int, keys: Sequence[str] = KEYS, by: Sequence[str] = KEYS, usual: int | None = None
) -> DataFrame:
    """``samples array<struct<sample_idx, continuation>>`` per request, ordered by sample.

    Texts move once, by ``by``, and are sorted after that; what follows on the same columns moves
    nothing. The preferred delivery of each sample number is kept while reading the sorted rows, so a
    request never holds more than ``n`` texts. Where a group is ``crowded`` with deliveries, more
    than twenty times the ``usual`` number, they are folded in the tasks before they move as well.
    Deliveries with a ``lot`` are folded where they lie (``requests.by_lot``).
    """
    usual = n if usual is None else usual
    in_order = bool(by_lot(cleaned)) and groups_in_order(cleaned.sparkSession)
    keys = lot_keys(cleaned) if by_lot(cleaned) else keys
    rows = cleaned if by_lot(cleaned) or crowded(cleaned, by, usual) else cleaned.repartition(*by)
    number = F.col("sample_idx").cast("int")
    answered = number.between(0, n - 1) & F.col("continuation").isNotNull()
    best = [F.min(_preferred(i)).alias(f"_s{i}") for i in range(n)]
    if in_order:
        # Neither sort is made where rows come in this order. With the set, of ``n`` numbers at most, Spark folds the
        # rows in one step; minima alone are folded in two, and each copies all texts.
        came = F.collect_set(F.when(answered, number)).alias("_came")
        folded = rows.sortWithinPartitions(*keys).groupBy(*keys).agg(came, *best).sortWithinPartitions(*keys)
    else:
        folded = rows.groupBy(*keys).agg(*best)
    samples = F.array(
        *[
            F.struct(F.lit(i).alias("sample_idx"), F.col(f"_s{i}.text").alias("continuation"))
            for i in range(n)
        ]
    )
    some = F.filter(samples, lambda s: s["continuation"].isNotNull())
    if in_order:
        some = F.when(F.size("_came") == n, samples).otherwise(some)
    return folded.select(*keys, some.alias("samples"))


def story_bags(cleaned: DataFrame, n_runs: int, config: StudyConfig) -> DataFrame:
    """``(story_id, bag)``, after the lot if there is one: all answered requests of a story, from texts that moved once, by story."""
    usual = n_runs * len(config.position_pcts) * config.n_continuations
    answers = gather_samples(cleaned, config.n_continuations, by=["story_id"], usual=usual)
    return answers.groupBy(*by_lot(cleaned), "story_id").agg(F.collect_list(F.struct("run", "position", "samples")).alias("bag"))


def attach_completions(
    requests: DataFrame,
    completions: DataFrame,
    runs: Sequence[Run] = RUNS,
    registry: Sequence[Model] = MODELS,
    config: StudyConfig = CURRENT,
) -> DataFrame:
    """Requests with their ``samples`` and ``continuations``; both empty for an unanswered one.

    Both sides meet on the full request key, so one aggregation shuffle serves the join too.
    """
    keys = lot_keys(requests, completions)
    cleaned = clean_completions(completions, runs, registry).select(*keys, "sample_idx", "delivery", "continuation")
    answers = gather_samples(cleaned, config.n_continuations)
    none = F.array().cast("array<struct<sample_idx: int, continuation: string>>")
    joined = requests.join(answers.hint("merge"), keys, "left").withColumn("samples", F.coalesce("samples", none))
    return joined.withColumn("continuations", F.col("samples.continuation"))


def sample_rows(attached: DataFrame) -> DataFrame:
    """``(run, story_id, position, sample_idx, continuation)`` with the samples' own numbers."""
    return attached.select(*KEYS, F.inline("samples"))


def finetune_rows(
    cleaned: DataFrame, cut_texts: DataFrame, config: StudyConfig = CURRENT
) -> DataFrame:
    """Self-contained rows: context, real rest and one alternative each.

    ``cut_texts`` comes from ``sentences.prefix_truth`` or is derived from it. Samples fold per
    request; the long texts are repeated per sample only after the join.
    """
    texts = cut_texts.select("story_id", "position", "prefix", "ground_truth_continuation")
    answers = gather_samples(cleaned.drop("lot"), config.n_continuations, by=["story_id", "position"], usual=len(RUNS) * config.n_continuations)
    rows = texts.join(answers.hint("merge"), ["story_id", "position"])
    return rows.select(
        *KEYS, "prefix", "ground_truth_continuation", F.inline("samples")
    ).select(*KEYS, "sample_idx", "prefix", "ground_truth_continuation", "continuation")


def finetune_stories(
    cleaned: DataFrame, cut: DataFrame, config: StudyConfig = CURRENT
) -> DataFrame:
    """The rows of ``finetune_rows`` from cut stories: each story's text is shuffled once.

    The samples of a story (runs x cuts x samples, at most) meet its sentences on the story id,
    and prefixes and remainders are put together after the join.
    """
    lot = by_lot(cut, cleaned)
    bags = story_bags(cleaned if lot else cleaned.drop("lot"), len(RUNS), config)
    rows = cut.join(bags.hint("merge"), [*lot, "story_id"])
    # Each cut takes its own share of the bag along; the whole bag is not copied per cut.
    cuts = F.transform(
        "cuts",
        lambda p: F.struct(
            p.alias("position"),
            sentences.prefix_at(p).alias("prefix"),
            sentences.truth_at(p).alias("ground_truth_continuation"),
            F.filter("bag", lambda b: b["position"] == p).alias("own"),
        ),
    )
    texts = rows.select("story_id", F.inline(cuts)).select(
        "story_id", "position", "prefix", "ground_truth_continuation", F.explode("own").alias("answer")
    )
    return texts.select(
        F.col("answer.run").alias("run"), "story_id", "position", "prefix", "ground_truth_continuation",
        F.inline("answer.samples"),
    ).select(*KEYS, "sample_idx", "prefix", "ground_truth_continuation", "continuation")
