"""Filters, shards, first N and resume."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from continuum.config import CURRENT
from continuum.operators import filters, ordering, progress
from continuum.plans import study
from continuum.sources import index


def frame(spark, ids, body="a b c"):
    return spark.createDataFrame([(i, body) for i in ids], "story_id string, text string")


def ids(df):
    return sorted(r.story_id for r in df.select("story_id").collect())


def test_id_range(spark):
    given = ["00000", "00199", "00200", "-1", "+5", "1_0", " 7 ", "x", "1.5", "", "9" * 60, "-" + "9" * 60]
    assert ids(filters.id_range(frame(spark, given))) == sorted(["00000", "00199", "+5", "1_0", " 7 "])
    assert "-1" in ids(filters.id_range(frame(spark, given), low=-5))


def test_word_cap_keeps_the_limit(spark):
    df = spark.createDataFrame([("a", "w " * 5000), ("b", "w " * 5001)], "story_id string, text string")
    assert ids(filters.word_cap(df)) == ["a"]


@pytest.mark.parametrize("many", [False, True])
def test_id_list_fills_and_ignores_unknown(spark, many):
    df = frame(spark, ["00015", "00056", "00057", "123456"])
    wanted = " 15,00056,99999, 123456"
    if many:
        wanted = wanted.split(",") + [str(i) for i in range(1000, 1400)]
    assert ids(filters.id_list(df, wanted)) == ["00015", "00056", "123456"]


def test_id_list_from_a_table(spark):
    wanted = spark.createDataFrame([(15,), (15,), (99,)], "doc_id bigint")
    assert ids(filters.id_list(frame(spark, ["00015", "00056"]), wanted)) == ["00015"]


@pytest.mark.parametrize("n, shards", [(13, 5), (3, 5), (20, 4), (1, 1), (101, 7)])
def test_shards_are_contiguous_and_complete(spark, n, shards):
    df = frame(spark, [f"{i:05d}" for i in range(n)]).repartition(3)
    parts = [ids(ordering.shard(df, i, shards)) for i in range(shards)]
    assert sum(parts, []) == [f"{i:05d}" for i in range(n)]
    small, extra = divmod(n, shards)
    assert [len(p) for p in parts] == [small + (i < extra) for i in range(shards)]


def test_shard_bounds(spark):
    df = frame(spark, [f"{i:05d}" for i in range(13)])
    rows = ordering.shard_bounds(df, 5).orderBy("shard_id").collect()
    assert [tuple(r) for r in rows][:2] == [(0, 3, "00000", "00002"), (1, 3, "00003", "00005")]


def test_global_index_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 16).select((F.col("id") * 7919 % 5003).alias("k"))
    rows = ordering.with_global_index(df, ["k"]).orderBy("k").collect()
    assert [r.idx for r in rows] == list(range(5000))
    assert {r.n_rows for r in rows} == {5000}


@pytest.mark.parametrize("top", [1, 1000])
@pytest.mark.parametrize("n", [0, 2, 50])
def test_first_n(spark, n, top, monkeypatch):
    monkeypatch.setattr(ordering, "_TOP_IDS", top)
    df = frame(spark, ["00003", "00001", "00002"])
    assert ids(ordering.first_n(df, n)) == ["00001", "00002", "00003"][: n or None]


def test_resume_twice_leaves_nothing(spark):
    df = frame(spark, ["00001", "00002", "00003"])
    done = spark.createDataFrame([("r", "00002"), ("other", "00001")], "run string, story_id string")
    left = filters.resume(df, filters.done_in(done, "r"))
    assert ids(left) == ["00001", "00003"]
    again = done.unionByName(left.select(F.lit("r").alias("run"), "story_id"))
    assert ids(filters.resume(df, filters.done_in(again, "r"))) == []


def test_selection_applies_in_order(spark):
    df = frame(spark, [f"{i:05d}" for i in range(190, 210)])
    picked = study.select_stories(df, study.Selection(id_filter=True, ids="195,205"))
    assert ids(picked) == ["00195"]  # 205 exists but falls to the id range first
    picked = study.select_stories(df, study.Selection(n_shards=4, shard_id=1, first_n=2))
    assert ids(picked) == ["00195", "00196"]
    assert CURRENT.max_story_id == 200


@pytest.mark.parametrize("n, shards", [(13, 5), (3, 5), (0, 2), (101, 7)])
def test_an_index_gives_the_same_shards(spark, tmp_path, n, shards):
    df = frame(spark, [f"{i:05d}" for i in range(n)] + ["x"], "One. Two. Three. Four. Five.").repartition(3)
    made = index.write_index(df, str(tmp_path / "index"))
    kept = filters.id_range(df)
    for i in range(shards):
        for first in (0, 1, 4):
            chosen = study.Selection(id_filter=True, shard_id=i, n_shards=shards, first_n=first)
            want = ids(study.select_stories(df, chosen))
            assert ids(study.select_stories(df, replace(chosen, index=made))) == want
            assert ids(ordering.indexed_slice(kept, made, i, shards, first)) == want
    listed = study.Selection(id_filter=True, ids="1,3,5,00007,9", shard_id=1, n_shards=2, first_n=1, index=made)
    assert ids(study.select_stories(df, listed)) == ids(study.select_stories(df, replace(listed, index=None)))
    bounds = lambda df: sorted(map(tuple, df.collect()))
    assert bounds(made.shard_bounds(shards)) == bounds(ordering.shard_bounds(kept, shards))
    assert bounds(progress.indexed_funnel(made, shards)) == bounds(progress.funnel_counts(df, n_shards=shards))
    assert made.flags.count() == n + 1


def test_shard_edges():
    for n, shards in [(13, 5), (3, 5), (0, 2), (20, 4)]:
        edges = ordering.shard_edges(n, shards)
        assert edges[0] == 0 and edges[-1] == n
        assert [b - a for a, b in zip(edges, edges[1:], strict=False)] == [n // shards + (i < n % shards) for i in range(shards)]
