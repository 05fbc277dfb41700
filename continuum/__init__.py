"""continuum: story-continuation datasets as Spark DataFrame jobs."""

from continuum.config import CURRENT, OLD, StudyConfig

__all__ = ["CURRENT", "OLD", "StudyConfig"]
