"""Prompts per mode. They depend on the mode, not on the run, so they are built at export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The prompt texts of the study.
SYSTEM_TEXT = (
    "You are a fiction writer. Continue the story naturally in the same style and voice. "
    "Write only story text — no commentary, no meta-discussion, no preamble, "
    "no quotation marks around your continuation."
)
USER_TEMPLATE = (
    "Continue this story to its conclusion in approximately {n_words} words. "
    "Maintain the same tone, style, and narrative voice throughout. "
    "Do not summarize or describe what happens — write the actual story text "
    "as it would appear on the page.\n"
    "\n"
    "STORY SO FAR:\n"
    "{story_so_far}"
)

_BEFORE_COUNT, _REST = USER_TEMPLATE.split("{n_words}")
_BEFORE_STORY, _AFTER_STORY = _REST.split("{story_so_far}")

# Words a chat prompt has besides the prefix; the word-count slot is one word.
CHAT_OVERHEAD_WORDS = len(SYSTEM_TEXT.split()) + len((_BEFORE_COUNT + "0" + _BEFORE_STORY).split())


def user_text(n_words: Column, prefix: Column) -> Column:
    """The filled template. Concatenation, so braces inside a story stay as they are."""
    return F.concat(
        F.lit(_BEFORE_COUNT), n_words.cast("string"), F.lit(_BEFORE_STORY), prefix, F.lit(_AFTER_STORY)
    )


def messages(n_words: Column, prefix: Column) -> Column:
    """Chat messages: ``array<struct<role, content>>``."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_TEXT).alias("content")),
        F.struct(F.lit("user").alias("role"), user_text(n_words, prefix).alias("content")),
    )


def prompt_base(cut_texts: DataFrame) -> DataFrame:
    """Base models get the prefix and nothing else."""
    return cut_texts.select("story_id", "position", F.col("prefix").alias("prompt"))


def prompt_chat(cut_texts: DataFrame) -> DataFrame:
    """Other models get a system and a user message."""
    chat = messages(F.col("target_n_words"), F.col("prefix"))
    return cut_texts.select("story_id", "position", chat.alias("messages"))


def prompt_words(prefix_words: Column, prompt_mode: Column) -> Column:
    """Words of the whole prompt, from the prefix's count alone."""
    return F.when(prompt_mode == "base_raw", prefix_words).otherwise(prefix_words + CHAT_OVERHEAD_WORDS)


def export_prompts(requests: DataFrame, cut_texts: DataFrame) -> DataFrame:
    """``export_rows`` of requests from elsewhere: the prefixes are joined on by story and cut.

    ``plans.study.export_requests`` builds requests and prompts from one row, without a join.
    """
    texts = cut_texts.select("story_id", "position", "prefix")
    return export_rows(requests.join(texts.hint("merge"), ["story_id", "position"]))


def export_rows(requests: DataFrame) -> DataFrame:
    """What a generation engine needs per request: prompt or messages, budget and sample count."""
    base = F.col("prompt_mode") == "base_raw"
    chat = messages(F.col("target_n_words"), F.col("prefix"))
    return requests.select(
        "run",
        "story_id",
        "position",
        F.when(base, F.col("prefix")).alias("prompt"),
        F.when(~base, chat).alias("messages"),
        F.when(F.col("is_reasoning"), F.col("enable_thinking")).alias("enable_thinking"),
        "max_tokens",
        "n_continuations",
        "temperature",
        "top_p",
    )
