"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from continuum.config import CURRENT
from continuum.functions import text
from continuum.operators import compare, completions, filters, ordering, progress, requests
from continuum.plans import study
from continuum.sources import catalogue, corpus, index
from tests.conftest import plan_of
from workload import queries as Q


@pytest.fixture(scope="module")
def stories(spark, sf):
    return corpus.read_table_corpus(spark, f"{sf}/documents.parquet", id_column="doc_id")


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_no_udf_and_no_cross_join(spark, sf, name):
    if name in ("stream_positions", "story_result_json", "written_checks"):
        pytest.skip("runs its job when built")
    plan = plan_of(Q.QUERIES[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in plan


def test_positions_are_narrow_and_split_once(stories):
    plan = plan_of(study.story_positions(stories))
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("regexp_extract_all") == 1
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", plan).group(1)
    assert schema == "struct<doc_id:bigint,text:string>"


def test_requests_are_narrow(stories):
    plan = plan_of(study.open_requests(stories))
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("regexp_extract_all") == 1


def test_ids_are_read_without_texts(stories):
    plan = plan_of(filters.id_range(stories).select("story_id"))
    assert "text" not in re.search(r"ReadSchema: (struct<[^>]*>)", plan).group(1)


def test_shard_and_first_n_become_pushed_range_filters(spark, tmp_path, stories):
    path = str(tmp_path / "table")
    corpus.write_table_corpus(stories, path)
    table = corpus.read_table_corpus(spark, path)
    plan = plan_of(ordering.shard(table, 1, 4))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "GreaterThanOrEqual(story_id,00050)" in pushed and "LessThanOrEqual(story_id,00099)" in pushed
    assert "Exchange" not in plan
    assert "LessThanOrEqual(story_id,00009)" in plan_of(ordering.first_n(table, 10))


def test_done_set_is_filtered_before_the_split(spark, stories):
    done = spark.createDataFrame([("00001",)], "story_id string")
    plan = plan_of(study.cut_stories(study.select_stories(stories, done=done)))
    assert plan.index("regexp_extract_all") < plan.index("LeftAnti")  # nearer the root, so later
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_large_done_set_is_not_broadcast(spark, stories, monkeypatch):
    from continuum.operators import joins

    many = spark.range(50).select(corpus.pad_id(F.col("id")).alias("story_id"))
    plain = joins.small_or_shuffled(many, max_rows=10)
    assert "broadcast" not in plain._jdf.queryExecution().analyzed().toString().lower()
    wide = joins.small_or_shuffled(many, max_rows=50, max_bytes=100)
    assert "broadcast" not in wide._jdf.queryExecution().analyzed().toString().lower()
    hinted = joins.small_or_shuffled(many, max_rows=50)
    assert "broadcast" in hinted._jdf.queryExecution().analyzed().toString().lower()
    assert filters.resume(stories, many).count() == stories.count() - 50


def test_completions_meet_requests_by_sort_merge(spark, stories):
    open_ = study.open_requests(stories)
    raw = open_.select(*requests.KEYS, F.lit(0).alias("sample_idx"), F.lit("x").alias("raw_text"))
    plan = plan_of(completions.attach_completions(open_, raw))
    assert "SortMergeJoin" in plan
    # one exchange per side: the aggregation's partitioning serves the join
    assert plan.count("Exchange hashpartitioning") == 2


def test_records_shuffle_stories_and_samples_once(spark, stories):
    open_ = study.open_requests(stories)
    raw = open_.select(*requests.KEYS, F.lit(0).alias("sample_idx"), F.lit("x").alias("raw_text"))
    plan = plan_of(study.story_records(stories, raw))
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("build", [study.story_records, study.finetuning, study.answered_requests])
def test_texts_are_not_sorted_before_they_move(spark, stories, tmp_path, build):
    path = str(tmp_path / "raw")
    rows = [("olmo3_base", "00001", 1, 0, "x")]
    schema = "run string, story_id string, position int, sample_idx int, raw_text string"
    spark.createDataFrame(rows, schema).write.parquet(path)
    plan = plan_of(build(stories, spark.read.parquet(path)))
    # Below the exchange of the samples, where their file is scanned, nothing is sorted or aggregated.
    samples = next(x for x in re.split(r"Exchange hashpartitioning", plan)[1:] if "raw_text" in x.split("FileScan")[1])
    below = samples.split("FileScan")[0]
    assert "Sort" not in below and "Aggregate" not in below


def test_shards_by_index_run_no_job_over_the_corpus(spark, tmp_path, stories):
    corpus.write_table_corpus(stories, str(tmp_path / "table"))
    table = corpus.read_table_corpus(spark, str(tmp_path / "table"))
    made = index.write_index(table, str(tmp_path / "index"), id_filter=False)
    spark.range(1).write.mode("overwrite").parquet(str(tmp_path / "table"))  # the corpus is gone
    plan = plan_of(ordering.indexed_slice(table, made, 1, 4))
    assert "Exchange" not in plan and "GreaterThanOrEqual(story_id,00050)" in plan
    chosen = study.Selection(shard_id=1, n_shards=4, first_n=3, index=made)
    plan = plan_of(study.select_stories(table, chosen))
    assert "GreaterThanOrEqual(story_id,00050)" in plan and "LessThanOrEqual(story_id,00052)" in plan
    assert made.n_stories() == 200 and made.shard_bounds(4).count() == 4


def test_an_index_without_the_word_cap_reads_no_text(stories):
    plan = plan_of(index.id_flags(stories))
    assert "text" not in re.search(r"ReadSchema: (struct<[^>]*>)", plan).group(1)


def test_the_funnel_reads_the_corpus_once(spark, stories, monkeypatch):
    reads = []
    flags = progress.story_flags
    monkeypatch.setattr(progress, "story_flags", lambda *a, **k: reads.append(1) or flags(*a, **k))
    plan = plan_of(progress.funnel_counts(stories, n_shards=3))
    assert reads == [1] and "text" not in plan and "ExistingRDD" in plan


@pytest.mark.parametrize("join", [filters.resume, filters.id_list])
def test_large_key_sets_move_no_text_of_a_bucketed_corpus(spark, stories, tmp_path, join):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1024")
    try:
        corpus.write_bucketed_corpus(stories, "bucketed_stories", str(tmp_path / "corpus"), 8)
        table = corpus.read_bucketed_corpus(spark, "bucketed_stories")
        keys = spark.range(100, 200_101).select(corpus.pad_id(F.col("id")).alias("story_id"))
        left = join(table, keys)
        plan = plan_of(left)
        assert "Bucketed: true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
        for exchange in re.findall(r"Exchange hashpartitioning\([^\n]*", plan):
            assert "text" not in exchange
        assert plan.count("Exchange hashpartitioning") == 1
        side = plan[plan.index("Exchange hashpartitioning") :]
        assert "text" not in side.split("FileScan")[0]
        assert left.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("DROP TABLE IF EXISTS bucketed_stories")


def test_reasoning_is_stripped_before_the_shuffle(spark):
    raw = spark.createDataFrame([("r", "1", 1, 0, "x")], "run string, story_id string, position int, sample_idx int, raw_text string")
    plan = plan_of(completions.gather_samples(completions.clean_completions(raw), 5))
    assert plan.index("Exchange") < plan.index("regexp_replace")  # below the exchange in the tree


def test_comparison_reads_only_its_runs(spark, tmp_path):
    path = str(tmp_path / "raw")
    schema = "run string, story_id string, position int, sample_idx int, raw_text string"
    spark.createDataFrame([("olmo3_base", "1", 1, 0, "x")], schema).write.partitionBy("run").parquet(path)
    plan = plan_of(compare.compare_stages(completions.clean_completions(spark.read.parquet(path)), CURRENT))
    assert re.search(r"PartitionFilters: \[[^\]]*run#\d+ IN", plan)
    assert plan.count("Exchange hashpartitioning") == 1


def test_run_flags_are_literals(spark, stories):
    df = catalogue.fan_out(stories.select("story_id"), ["run"])
    assert "transform(" not in plan_of(df)


def test_word_cap_skips_counting_short_texts(stories):
    plan = plan_of(stories.filter(text.at_most_words(F.col("text"), 5000)))
    assert "octet_length" in plan
