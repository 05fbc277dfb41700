from __future__ import annotations

import pytest
from cases import prose

from continuum.llm.store import importable

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use inside must pass or be ignored.
CLASHES = {"node": "x", "group": 1, "n": 2, "ids": "y", "comp": 3, "end": 4}


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    importable(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    from pyspark.sql import functions as F

    long = prose(5, 9000)
    rows = [
        (1, prose(1, 80), "en", "a", 1),
        (1, prose(1, 80), "en", "a", 1),
        (2, None, None, None, None),
        (None, prose(2, 80), "en", "b", 2),
        (None, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, long, "en", "b", len(long)),
        (5, long + "\nOne more line that ends here.", "en", "c", 0),
        (6, "one", "en", "c", 3),
        (7, "é<|x|>  \t\n\n\x0b ü🙂 " + "same same " * 60, "de", None, 9),
        (2**53 + 1, prose(3, 60), "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name, value in CLASHES.items():
        df = df.withColumn(name, F.lit(value))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
