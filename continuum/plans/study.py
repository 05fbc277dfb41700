"""The study from corpus to records, as plain compositions of the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuum.config import CURRENT, StudyConfig
from continuum.operators import completions as C
from continuum.operators import filters, ordering, prompts, records, requests, sentences
from continuum.operators.joins import anti_join
from continuum.sources.catalogue import MODELS, RUNS, Model, Run
from continuum.sources.index import StoryIndex


@dataclass(frozen=True)
class Selection:
    """Which stories a pass works on; the fields apply in this order.

    An ``index`` of the same corpus, id range and word cap gives shards and first-N without a job
    over the corpus; with an id list, which no index knows, only the index's ids are sorted.
    """

    id_filter: bool = False
    min_id: int | None = None
    max_id: int | None = None
    ids: str | Sequence[str] | DataFrame | None = None
    shard_id: int = 0
    n_shards: int = 1
    first_n: int = 0
    index: StoryIndex | None = None


EVERYTHING = Selection()


def select_stories(
    stories: DataFrame,
    selection: Selection = EVERYTHING,
    config: StudyConfig = CURRENT,
    *,
    done: DataFrame | None = None,
) -> DataFrame:
    """Id range, word cap, id list, shard, first N, resume: cheap filters before any split."""
    if selection.id_filter:
        low = config.min_story_id if selection.min_id is None else selection.min_id
        high = config.max_story_id if selection.max_id is None else selection.max_id
        stories = filters.id_range(stories, low, high)
    stories = filters.word_cap(stories, config.max_words)
    if selection.ids is not None:
        stories = filters.id_list(stories, selection.ids)
    index = selection.index
    if index is not None and selection.ids is None:
        if selection.n_shards > 1 or selection.first_n > 0:
            stories = ordering.indexed_slice(
                stories, index, selection.shard_id, selection.n_shards, selection.first_n
            )
    else:
        known = stories if index is None else filters.id_list(index.ordered.select("story_id"), selection.ids)
        stories = ordering.slice_by(stories, known, selection.shard_id, selection.n_shards, selection.first_n)
    return stories if done is None else filters.resume(stories, done)


def cut_stories(stories: DataFrame, config: StudyConfig = CURRENT) -> DataFrame:
    """Sentences, sizes and cut points of selected stories: one row per story."""
    return sentences.with_cuts(sentences.with_sentences(stories), config)


def story_positions(stories: DataFrame, config: StudyConfig = CURRENT) -> DataFrame:
    """Cut rows without text of all stories under the word cap."""
    return sentences.positions(cut_stories(select_stories(stories, config=config), config))


def story_texts(stories: DataFrame, config: StudyConfig = CURRENT) -> DataFrame:
    """Prefix and real remainder at each cut of all stories under the word cap."""
    return sentences.prefix_truth(cut_stories(select_stories(stories, config=config), config))


def open_requests(
    stories: DataFrame,
    runs: Sequence[Run] = RUNS,
    registry: Sequence[Model] = MODELS,
    config: StudyConfig = CURRENT,
    *,
    token_counts: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Requests that fit the context window, for every run.

    With ``partitions``, here and below, the stories carry a ``lot`` and are dealt to so many partitions by it
    before they fan out; completions that lie the same way are not moved (``requests.by_lot``).

    ``token_counts (run, story_id, position, prompt_tokens)``, here and below, replaces the estimate
    of a prompt's tokens where a tokenizer's count is at hand.
    """
    cuts = requests.with_token_counts(requests.deal(story_positions(stories, config), partitions), token_counts)
    planned = requests.requests(cuts, runs, registry, config)
    return requests.context_guard(planned, config)


def export_requests(
    stories: DataFrame,
    runs: Sequence[Run] = RUNS,
    registry: Sequence[Model] = MODELS,
    config: StudyConfig = CURRENT,
    *,
    token_counts: DataFrame | None = None,
) -> DataFrame:
    """Open requests with their prompts, from one row per story: narrow, no text is shuffled.

    With counts each story is shuffled once, to meet them.
    """
    cut = cut_stories(select_stories(stories, config=config), config)
    cut = requests.with_token_counts(cut, token_counts)
    cuts = sentences.positions(cut, with_prefix=True)
    planned = requests.requests(cuts, runs, registry, config, keep=["prefix"])
    return prompts.export_rows(requests.context_guard(planned, config))


def finetuning(
    stories: DataFrame,
    completions: DataFrame,
    runs: Sequence[Run] = RUNS,
    registry: Sequence[Model] = MODELS,
    config: StudyConfig = CURRENT,
    *,
    partitions: int | None = None,
) -> DataFrame:
    """Fine-tuning rows of all stories under the word cap."""
    cut = requests.deal(cut_stories(select_stories(stories, config=config), config), partitions)
    return C.finetune_stories(C.clean_completions(completions, runs, registry), cut, config)


def pending_requests(
    stories: DataFrame,
    done: DataFrame,
    runs: Sequence[Run] = RUNS,
    registry: Sequence[Model] = MODELS,
    config: StudyConfig = CURRENT,
    *,
    token_counts: DataFrame | None = None,
) -> DataFrame:
    """Open requests of the (run, story) pairs not in ``done``.

    Stories finished in every run leave before the split; single pairs leave afterwards, by keys.
    """
    planned = done.filter(F.col("run").isin([r.run for r in runs])).select("run", "story_id").distinct()
    finished = planned.groupBy("story_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(runs))
    rest = filters.resume(stories, finished)
    open_ = open_requests(rest, runs, registry, config, token_counts=token_counts)
    return anti_join(open_, planned, ["run", "story_id"])


def answered_requests(
    stories: DataFrame,
    completions: DataFrame,
    runs: Sequence[Run] = RUNS,
    registry: Sequence[Model] = MODELS,
    config: StudyConfig = CURRENT,
    *,
    token_counts: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Requests with their cleaned continuations."""
    open_ = open_requests(stories, runs, registry, config, token_counts=token_counts, partitions=partitions)
    return C.attach_completions(open_, completions, runs, registry, config)


def story_records(
    stories: DataFrame,
    completions: DataFrame,
    runs: Sequence[Run] = RUNS,
    registry: Sequence[Model] = MODELS,
    config: StudyConfig = CURRENT,
    *,
    complete: bool = True,
    done: DataFrame | None = None,
    token_counts: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Nested records of every run: the complete ones that are not in ``done``."""
    cut = requests.deal(cut_stories(select_stories(stories, config=config), config), partitions)
    cut = requests.with_token_counts(cut, token_counts)
    return records.nest_story(cut, completions, runs, registry, config, complete=complete, done=done)
