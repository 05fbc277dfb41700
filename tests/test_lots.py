"""Tables dealt by lot: the same results as without lots, and no text of a sample moves."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from continuum.config import CURRENT
from continuum.operators import checks, compare, completions
from continuum.operators.requests import KEYS, deal
from continuum.plans import study
from continuum.sources import results
from continuum.sources.catalogue import RUNS
from tests.conftest import plan_of
from workload import fixtures, queries

TEXT = " ".join(f"S{i} word here." for i in range(10))
N = 3


def lot(df):
    return df.withColumn("lot", F.col("story_id").cast("long") % 5)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(f"{i:05d}", "f", TEXT) for i in range(12)] + [("00003", "twice", TEXT)]
    stories = spark.createDataFrame(rows, "story_id string, source_file string, text string")
    open_ = study.open_requests(stories).select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("sample_idx"))
    text = F.concat_ws(" ", F.lit("<think>p</think> o"), *KEYS, "sample_idx")
    raw = open_.select("*", F.lit(0).alias("delivery"), text.alias("raw_text"))
    again = raw.filter("sample_idx = 1").withColumn("delivery", F.lit(1)).withColumn("raw_text", F.lit(""))
    odd = raw.filter("sample_idx = 2 AND story_id = '00004'").withColumn("run", F.lit("ghost"))
    raw = raw.filter("NOT (sample_idx = 4 AND story_id = '00002')").unionByName(again).unionByName(odd)
    done = raw.filter("story_id < '00003'").select("run", "story_id").filter(F.col("run") < "m").distinct()
    return stories, raw.localCheckpoint(), done


BUILDS = {
    "requests": lambda s, c, d, n: completions.sample_rows(study.answered_requests(s, c, partitions=n)),
    "records": lambda s, c, d, n: study.story_records(s, c, done=d, partitions=n),
    "finetune": lambda s, c, d, n: study.finetuning(s, c, partitions=n),
    "pairs": lambda s, c, d, n: compare.compare_pairs(completions.clean_completions(c), CURRENT),
    "counts": lambda s, c, d, n: checks.check_output_count(study.open_requests(s, partitions=n), c),
    "checks": lambda s, c, d, n: checks.check_completions(study.open_requests(s, partitions=n), c),
}


@pytest.mark.parametrize("name", sorted(BUILDS))
def test_lots_change_no_row_and_move_no_sample(tables, name):
    plain = BUILDS[name](*tables, None)
    stories, raw, done = (deal(lot(t), N) for t in tables)
    dealt = BUILDS[name](lot(tables[0]), raw, done, N)
    columns = [c for c in plain.columns if c != "lot"]
    text = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert text(dealt) == text(plain)
    assert not re.findall(r"hashpartitioning\((?!lot#\d+L?, 3\)|run#\d+,)[^\n]*", plan_of(dealt))


def test_a_cut_is_grouped_without_sorting_its_texts_again(tables):
    raw = deal(lot(tables[1]), N)
    plan = plan_of(compare.compare_pairs(completions.clean_completions(raw), CURRENT))
    assert plan.count("Sort [") == 1 and "ObjectHashAggregate" not in plan


def test_sorted_samples_are_folded_in_one_step(spark, sf):
    plan = plan_of(queries.nest_story(spark, sf))
    assert "partial_min(" not in plan.partition("ShuffledHashJoin")[0] and "ObjectHashAggregate" not in plan
    assert "min(CASE" in plan


def test_a_record_is_told_complete_before_it_is_built(spark, sf):
    plan = plan_of(queries.nest_story(spark, sf))
    condition = next(line for line in plan.splitlines() if "- Filter forall(" in line)
    assert ".prefix," not in condition


def test_lots_that_are_numbers_get_a_partition_each(spark):
    rows = deal(spark.range(40).select((F.col("id") % 8).cast("int").alias("lot"), "id"), 8)
    found = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("lot").alias("n"), F.first("lot").alias("lot"))
    assert sorted(map(tuple, found.collect())) == [(i, 1, i) for i in range(8)]


@pytest.mark.parametrize("n_turns", [3, 45, 400])
def test_lots_are_even_partitions_whatever_the_turns(spark, tmp_path, n_turns):
    ids = spark.range(1600).selectExpr("id AS doc_id", "'t' AS text")
    ids.write.parquet(str(tmp_path / "documents.parquet"))
    turns = spark.range(n_turns).selectExpr("id AS conv_id", "0L AS turn", "'assistant' AS role", "'t' AS text")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    n = fixtures.partitions(spark, str(tmp_path))
    stories = ids.select(F.col("doc_id").cast("string").alias("story_id"))
    lots = fixtures.with_lot(spark, str(tmp_path), stories).groupBy("lot").count().collect()
    assert {r["lot"] for r in lots} == set(range(n)) and max(r["count"] for r in lots) < 2 * 1600 / n
    # A lot has the stories of one stretch of turns.
    first = F.pmod(F.col("story_id").cast("long") * 20, F.lit(n_turns))
    ends = fixtures.with_lot(spark, str(tmp_path), stories).groupBy("lot").agg(F.max(first) - F.min(first)).collect()
    assert max(r[1] for r in ends) <= n_turns // max(1, min(n, n_turns // 20)) + 1


def test_texts_of_completions_are_never_sorted(spark, sf):
    plan = plan_of(queries.compare_pairs(spark, sf))
    above, _, below = plan.partition("ShuffledHashJoin")
    assert below and "Sort [" not in above and "Exchange" not in above.replace("BroadcastExchange", "")


def test_faults_are_drawn_by_compiled_steps(spark, sf):
    plan = plan_of(fixtures.all_completions(spark, sf, queries.open_in_lots(spark, sf)))
    assert "Generate inline(" not in plan.partition("Sort [")[2].partition("Generate explode")[0]


def test_checks_in_one_pass_equal_those_apart(tables):
    stories, raw, _ = tables
    open_ = study.open_requests(stories)
    apart = checks.check_output_texts(completions.clean_completions(raw)).unionByName(checks.check_output_count(open_, raw))
    assert sorted(checks.check_completions(open_, raw).collect()) == sorted(apart.collect())


def test_committed_json_is_compressed(spark, tables, tmp_path):
    stories, raw, _ = tables
    results.commit_records(study.story_records(stories, raw, complete=False), str(tmp_path), "a")
    files = [p for p in tmp_path.glob("batch=a/run=*/part-*")]
    assert files and all(p.name.endswith(".json.gz") for p in files)
    assert results.read_committed(spark, str(tmp_path)).count() == 13 * len(RUNS)
