"""From stories to sentences and cut points. Narrow all the way: no shuffle, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuum.config import CURRENT, StudyConfig
from continuum.functions import study, text


def with_sentences(stories: DataFrame) -> DataFrame:
    """Replace ``text`` by ``sentences array<string>``.

    The array passes through a one-element ``explode`` so that it is computed once per
    story. As a plain column, the optimizer would copy the expression into each filter
    and projection above it and run the regular expression again for each.
    """
    kept = [c for c in stories.columns if c != "text"]
    pieces = text.sentences(text.clean(F.col("text")))
    return stories.select(*kept, F.explode(F.array(pieces)).alias("sentences"))


def with_story_size(split: DataFrame) -> DataFrame:
    """Add ``sentence_words array<int>``, ``n_sentences`` and ``n_words``.

    Sentences break at whitespace, so their word counts add up: to the story's count here,
    and to the count of any prefix or remainder later. Each word is counted once.
    """
    kept = [F.col(c) for c in split.columns]
    per_sentence = F.transform("sentences", text.word_count)
    return split.select(*kept, F.explode(F.array(per_sentence)).alias("sentence_words")).select(
        *kept,
        "sentence_words",
        F.size("sentences").alias("n_sentences"),
        _total(F.col("sentence_words")).alias("n_words"),
    )


def min_sentences(split: DataFrame, least: int = CURRENT.min_sentences) -> DataFrame:
    """Stories with fewer sentences give no output at all."""
    return split.filter(F.size("sentences") >= least)


def sentence_rows(split: DataFrame) -> DataFrame:
    """``(story_id, idx, sentence)``, idx from 0."""
    return split.select("story_id", F.posexplode("sentences").alias("idx", "sentence"))


def story_stats(split: DataFrame) -> DataFrame:
    return with_story_size(split).select("story_id", "n_sentences", "n_words")


def with_cuts(split: DataFrame, config: StudyConfig = CURRENT) -> DataFrame:
    """Story sizes plus ``cuts array<int>``, for stories long enough to be cut."""
    sized = with_story_size(min_sentences(split, config.min_sentences))
    return sized.withColumn("cuts", study.cut_points(F.col("n_sentences"), config.position_pcts))


def positions(cut: DataFrame, *, with_prefix: bool = False) -> DataFrame:
    """One narrow row per story and cut: sizes only, no text, or with the prefix beside them."""
    p, n = F.col("position"), F.col("n_sentences")
    texts = ["sentences"] if with_prefix else []
    counts = [c for c in cut.columns if c in ("token_counts", "lot")]
    return cut.select(
        "story_id", "n_sentences", "n_words", "sentence_words", *texts, *counts, F.explode("cuts").alias("position")
    ).select(
        "story_id",
        "position",
        p.alias("n_context_sentences"),
        (n - p).alias("n_remaining_sentences"),
        study.pct_revealed(p, n).alias("pct_story_revealed"),
        words_before(p).alias("prefix_words"),
        words_after(p).alias("target_n_words"),
        *([prefix_at(p).alias("prefix")] if with_prefix else []),
        *counts,
    )


def prefix_truth(cut: DataFrame) -> DataFrame:
    """``(story_id, position, target_n_words, prefix, ground_truth_continuation)``."""
    p = F.col("position")
    return cut.select(
        "story_id", "n_sentences", "sentences", "sentence_words", F.explode("cuts").alias("position")
    ).select(
        "story_id",
        "position",
        words_after(p).alias("target_n_words"),
        prefix_at(p).alias("prefix"),
        truth_at(p).alias("ground_truth_continuation"),
    )


def prefix_at(position: Column) -> Column:
    return F.array_join(F.slice("sentences", F.lit(1), position), " ")


def truth_at(position: Column) -> Column:
    return F.array_join(F.slice("sentences", position + 1, F.size("sentences")), " ")


def words_before(position: Column) -> Column:
    return _total(F.slice("sentence_words", F.lit(1), position))


def words_after(position: Column) -> Column:
    return _total(F.slice("sentence_words", position + 1, F.size("sentence_words")))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda acc, x: acc + x)
