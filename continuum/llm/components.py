"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuum.sources.shared import cut_lineage


def _toward(pairs: DataFrame) -> DataFrame:
    """Pairs with, for each ``u``, the least of its partners as ``m``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` that is not itself the root.

    The root is the least node of the component. Minima are combined before the shuffle, and
    each round is checkpointed; the rounds needed grow with the logarithm of the diameter.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut_lineage(e.filter("u <> v").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward(both).filter("v > u").select(
            F.col("v").alias("u"), F.least("m", "u").alias("v")
        )
        small = _toward(large.distinct())
        e = cut_lineage(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        check = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        new = e.agg(F.count("*"), check).first()
        if new == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new
