"""Cut points, percentages and budgets."""

from __future__ import annotations

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from continuum.config import CURRENT, OLD
from continuum.functions import study


def half_even(x: Fraction) -> int:
    low = x.numerator // x.denominator
    rest = x - low
    return low + (1 if rest > Fraction(1, 2) or (rest == Fraction(1, 2) and low % 2) else 0)


@pytest.mark.parametrize("n, want", [(5, [2, 3, 4]), (7, [3, 4, 6]), (10, [4, 6, 8, 9])])
def test_known_cuts(spark, n, want):
    row = spark.range(1).select(study.cut_points(F.lit(n), CURRENT.position_pcts)).first()
    assert row[0] == want


@pytest.mark.parametrize("config", [CURRENT, OLD])
def test_cuts_for_every_length(spark, config):
    df = spark.range(1, 3001).select(F.col("id").cast("int").alias("n"))
    rows = df.select("n", study.cut_points(F.col("n"), config.position_pcts).alias("cuts")).collect()
    for n, cuts in rows:
        assert cuts == sorted(set(cuts))
        if n > 1:
            assert 1 <= cuts[0] and cuts[-1] <= n - 1
        for pct in config.position_pcts:
            # the product is taken in doubles, then rounded exactly
            assert max(1, min(half_even(Fraction(pct * n)), n - 1)) in cuts


def test_percentage_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(13, 16), (2, 5), (54, 134)], "p int, n int")
    got = [r[0] for r in df.select(study.pct_revealed(F.col("p"), F.col("n"))).collect()]
    assert got == [81.2, 40.0, 40.3]


def test_budget_examples(spark):
    rows = [(0, 1.3, False, 100), (0, 2.0, True, 2148), (5000, 1.3, False, 4096), (5000, 2.0, True, 8192),
            (1000, 1.3, False, 1690), (1000, 2.0, True, 4648)]
    df = spark.createDataFrame(rows, "w int, mult double, think boolean, want int")
    budget = study.token_budget(F.col("w"), F.col("mult"), F.col("think"))
    for got, want in df.select(budget, "want").collect():
        assert got == want


def test_budget_stays_between_floor_and_clamp(spark):
    df = spark.range(0, 6001, 7).select(F.col("id").cast("int").alias("w"))
    for think, low, high in [(False, 100, 4096), (True, 2148, 8192)]:
        b = study.token_budget(F.col("w"), F.lit(2.0), F.lit(think))
        lo, hi = df.agg(F.min(b), F.max(b)).first()
        assert (lo, hi) == (low, high)
