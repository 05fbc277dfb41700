"""Text rules: fixed examples, and random strings against plain Python or DuckDB."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from continuum.functions import text
from workload import oracle

SENTENCES = [
    ("! Foo bar. Baz", ["!", "Foo bar.", "Baz"]),
    ("  A. B. C. ", ["A.", "B.", "C."]),
    (
        'He said "Hi."  "Yes?" (Go.) [Ok] done. no. “Q!” Then. New',
        ['He said "Hi."', '"Yes?"', "(Go.)", "[Ok] done. no.", "“Q!”", "Then.", "New"],
    ),
    ("Wait...What? Yes!!  No", ["Wait...What?", "Yes!!", "No"]),
    ("a.\x1cB.\x85C.　D", ["a.", "B.", "C.", "D"]),
    ("A.\x0bB.​C", ["A.", "B.​C"]),
    ("One.\r\nTwo.\rThree", ["One.", "Two.", "Three"]),
    ("Keep\u0001this. Marker \u0001 too. x", ["Keep\u0001this.", "Marker \u0001 too. x"]),
    ("Élan. Été. étude. 9 lives. Go", ["Élan. Été. étude. 9 lives.", "Go"]),
    ("", []),
    ("   ", []),
]

REASONING = [
    ("x\ny</THINK>\n ANS", "ANS"),
    ("pre <Think>q</think> post", "pre  post"),
    ("<think>a<think>b</think>c</think>d", "d"),
    ("a</think>b</think>c", "b</think>c"),
    ("<think>unclosed", "<think>unclosed"),
    ("<think>\nline one\nline two\n</think>\nThe end.", "The end."),
    ("a <think>1</think> b <THINK>2</THINK> c", "a  b  c"),
    ("<thınK>x</THİNK> y", "y"),
    ("no tags, </b> only", "no tags, </b> only"),
    ("  plain \x1c", "plain"),
]


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[1] for r in df.select("i", expr(F.col("s")).alias("x")).orderBy("i").collect()]


def test_sentences(spark):
    got = values(spark, [s for s, _ in SENTENCES], lambda c: text.sentences(text.clean(c)))
    assert got == [want for _, want in SENTENCES]


def test_strip_reasoning(spark):
    assert values(spark, [s for s, _ in REASONING], text.strip_reasoning) == [w for _, w in REASONING]


def test_reasoning_tag_is_found_in_any_case(spark):
    rows = ["<think>", "</Think>", "think", "< think>", None]
    assert values(spark, rows, text.has_reasoning_tag) == [True, True, False, False, None]


def random_texts(n, seed=7):
    rng = random.Random(seed)
    alphabet = list("abAB.!?\"”’)([“ ") + list(text.WHITESPACE) + ["​", "é", "É", "9", "\U0001f600"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_strip_and_word_count_equal_python(spark):
    texts = random_texts(600)
    assert values(spark, texts, text.strip) == [t.strip() for t in texts]
    assert values(spark, texts, text.word_count) == [len(t.split()) for t in texts]


def test_sentences_equal_sql_on_random_texts(spark):
    texts = random_texts(800, seed=11)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    sql = "WITH " + oracle._STORIES + ", " + oracle._SPLIT + " SELECT sentences FROM split ORDER BY doc_id"
    want = [r[0] for r in con.execute(sql).fetchall()]
    assert values(spark, texts, lambda c: text.sentences(text.clean(c))) == want


def test_sentences_keep_every_word(spark):
    texts = random_texts(300, seed=3)
    for got, whole in zip(values(spark, texts, lambda c: text.sentences(text.clean(c))), texts):
        assert " ".join(got).split() == whole.split()
        assert all(s and s == s.strip() for s in got)


@pytest.mark.parametrize("limit", [0, 1, 3, 7])
def test_at_most_words_is_exact(spark, limit):
    texts = random_texts(300, seed=5) + ["a b c d", "a  b", "é é é", "a b c d e f g h"]
    got = values(spark, texts, lambda c: text.at_most_words(c, limit))
    assert got == [len(t.split()) <= limit for t in texts]


def test_very_long_text_without_boundary(spark):
    long = spark.range(1).select(F.expr("repeat('word ', 400000)").alias("s"))
    row = long.select(
        F.size(text.sentences(text.clean(F.col("s")))), text.word_count(F.col("s"))
    ).first()
    assert tuple(row) == (1, 400000)


def test_zero_fill_equals_python(spark):
    ids = ["", "7", "-7", "+12", "12345", "1234567", "abc"]
    assert values(spark, ids, lambda c: text.zero_fill(c, 5)) == [i.zfill(5) for i in ids]
