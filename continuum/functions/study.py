"""Numeric rules of the study as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from continuum.config import CURRENT, StudyConfig


def cut_points(n_sentences: Column, pcts: Sequence[float]) -> Column:
    """Ascending distinct cut points. ``rint`` rounds halves to even, as the study does."""
    cuts = [
        F.greatest(F.lit(1), F.least(F.rint(F.lit(float(p)) * n_sentences).cast("int"), n_sentences - 1))
        for p in pcts
    ]
    return F.array_sort(F.array_distinct(F.array(*cuts)))


def pct_revealed(position: Column, n_sentences: Column) -> Column:
    """Share of sentences revealed, in percent, one decimal, halves to even."""
    return F.bround(position / n_sentences * F.lit(100), 1)


def token_budget(
    target_words: Column, mult: Column, strip_think: Column, config: StudyConfig = CURRENT
) -> Column:
    """Generation budget in tokens. All arithmetic before the floor stays in doubles."""
    extra = F.when(strip_think, config.thinking_tokens).otherwise(0)
    clamp = F.when(strip_think, config.thinking_clamp).otherwise(config.token_clamp)
    scaled = F.floor(target_words.cast("double") * F.lit(config.tokens_per_word) * mult.cast("double"))
    return F.least(F.greatest(scaled + extra, extra + config.token_floor), clamp).cast("int")


def estimated_tokens(words: Column, config: StudyConfig = CURRENT) -> Column:
    """Token *estimate* from a word count. Not a tokenizer's count."""
    return F.ceil(words.cast("double") * F.lit(config.tokens_per_word)).cast("int")
