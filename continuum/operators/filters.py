"""Story filters, in the order the study applies them: id range, word cap, id list, resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuum.config import CURRENT
from continuum.functions import text
from continuum.operators.joins import anti_join, semi_join
from continuum.sources.corpus import ID_WIDTH

_INLINE_IDS = 200


def id_number(story_id: Column) -> Column:
    """The id as a whole number, NULL if it is none. Blanks around and ``_`` between digits pass."""
    bare = text.strip(story_id)
    digits = F.replace(bare, F.lit("_"), F.lit(""))
    return F.when(bare.rlike(r"\A[+-]?[0-9]+(_[0-9]+)*\z"), digits.try_cast("decimal(38,0)"))


def id_range(
    stories: DataFrame, low: int = CURRENT.min_story_id, high: int = CURRENT.max_story_id
) -> DataFrame:
    """Keep ``low <= id < high``; ids that are no whole numbers are dropped."""
    number = id_number(F.col("story_id"))
    return stories.filter((number >= low) & (number < high))


def word_cap(stories: DataFrame, max_words: int = CURRENT.max_words) -> DataFrame:
    """Drop stories of more than ``max_words`` words."""
    return stories.filter(text.at_most_words(F.col("text"), max_words))


def id_list(stories: DataFrame, ids: str | Sequence[str] | DataFrame) -> DataFrame:
    """Keep listed ids, zero-filled to the usual width. Unknown ids are ignored.

    A comma list or sequence is inlined when short; a DataFrame is taken as a table whose
    first column holds the ids.
    """
    if isinstance(ids, str):
        ids = ids.split(",")
    if not isinstance(ids, DataFrame):
        wanted = sorted({i.strip().zfill(ID_WIDTH) for i in ids})
        if len(wanted) <= _INLINE_IDS:
            return stories.filter(F.col("story_id").isin(wanted))
        ids = stories.sparkSession.createDataFrame([(i,) for i in wanted], "story_id string")
    else:
        ids = ids.select(
            text.zero_fill(text.strip(F.col(ids.columns[0]).cast("string")), ID_WIDTH).alias("story_id")
        )
    return semi_join(stories, ids, "story_id")


def resume(stories: DataFrame, done: DataFrame) -> DataFrame:
    """Stories not in the done-set of the run at hand. Apply before the text is split."""
    return anti_join(stories, done.select("story_id"), "story_id")


def done_in(done: DataFrame, run: str) -> DataFrame:
    """The done-set of one run from a ``(run, story_id)`` table; prunes a table partitioned by run."""
    return done.filter(F.col("run") == run).select("story_id")
