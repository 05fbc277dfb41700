"""Catalogue, prompts, requests and the context guard."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from continuum.config import CURRENT
from continuum.operators import prompts, requests
from continuum.plans import study
from continuum.sources import catalogue
from continuum.sources.catalogue import Model, Run

STORY = "One a. Two {n_words} b. Three c. Four {d}. Five e. Six f. Seven g. Eight h. Nine i. Ten j."


@pytest.fixture(scope="module")
def stories(spark):
    return spark.createDataFrame([("00001", "mem", STORY)], "story_id string, source_file string, text string")


def test_catalogue_size_and_names(spark):
    runs = catalogue.run_table(spark).collect()
    assert len(runs) == 20 and len({r.run for r in runs}) == 20
    assert sum(r.prompt_mode == "base_raw" for r in runs) == 5
    assert {r.run_no for r in runs if r.strip_think} == {10, 12, 13, 18, 19, 20}
    assert {r.run_no for r in runs if r.tensor_parallel_size == 4} == {7, 8}
    assert len(catalogue.MODELS) == 18
    assert [sum(flags) for flags in zip(*[m[1:] for m in catalogue.MODELS])] == [5, 6, 5, 2]


def test_literal_catalogue_equals_the_joined_one(spark):
    fields = ["run_no", "run", "model", "prompt_mode", "is_reasoning", "enable_thinking", "strip_think",
              "tensor_parallel_size", "quantization", "max_tokens_mult"]
    literal = catalogue.fan_out(spark.range(1).select(), fields)
    joined = catalogue.run_table(spark).select(*fields)
    assert sorted(map(str, literal.collect())) == sorted(map(str, joined.collect()))


def test_unknown_model_counts_as_instruct(spark):
    df = spark.createDataFrame([("made/up",)], "model string")
    row = catalogue.classify(df).first()
    assert (row.model_class, row.is_base, row.is_vlm) == ("instruct", False, False)
    thinking = [Run(1, "r", "made/up", thinking=True)]
    row = catalogue.run_table(spark, thinking).first()
    assert (row.prompt_mode, row.enable_thinking, row.strip_think) == ("chat", False, False)


def test_any_number_of_runs(spark, stories):
    runs = [Run(i, f"r{i}", "made/up") for i in range(1_001)]
    assert catalogue.run_table(spark, runs).count() == 1_001
    planned = study.open_requests(stories, runs)
    assert planned.select("run").distinct().count() == 1_001
    many = catalogue.dimension(spark, [(i,) for i in range(catalogue.BROADCAST_ROWS + 1)], "i int")
    assert many.count() == catalogue.BROADCAST_ROWS + 1


def test_prompts(spark, stories):
    texts = study.story_texts(stories)
    base = {r.position: r.prompt for r in prompts.prompt_base(texts).collect()}
    assert base[4] == "One a. Two {n_words} b. Three c. Four {d}."
    chat = {r.position: r.messages for r in prompts.prompt_chat(texts).collect()}
    assert [m.role for m in chat[4]] == ["system", "user"]
    assert chat[4][0].content == prompts.SYSTEM_TEXT
    assert chat[4][1].content == prompts.USER_TEMPLATE.format(n_words=12, story_so_far=base[4])


def test_prompt_words_equal_a_recount(spark, stories):
    texts = {r.position: r for r in study.story_texts(stories).collect()}
    rows = requests.requests(study.story_positions(stories)).collect()
    for r in rows:
        t = texts[r.position]
        whole = t.prefix
        if r.prompt_mode == "chat":
            user = prompts.USER_TEMPLATE.format(n_words=t.target_n_words, story_so_far=t.prefix)
            whole = prompts.SYSTEM_TEXT + " " + user
        words = len(whole.split())
        assert r.prompt_tokens_est == -(-words * 13 // 10)


def test_every_cut_for_every_run(spark, stories):
    df = requests.requests(study.story_positions(stories))
    assert df.count() == 4 * 20
    assert df.groupBy("run").count().filter("count <> 4").isEmpty()


def test_guard_drops_only_what_exceeds(spark, stories):
    df = requests.requests(study.story_positions(stories))
    total = F.col("prompt_tokens_est") + F.col("max_tokens")
    limit = df.agg(F.max(total)).first()[0]
    assert requests.context_guard(df, replace(CURRENT, context_length=limit)).count() == 80
    assert requests.context_guard(df, replace(CURRENT, context_length=limit - 1)).count() < 80


def test_supplied_token_counts_win(spark, stories):
    pos = study.story_positions(stories)
    counts = spark.createDataFrame(
        [("olmo3_base", "00001", 4, 40000)], "run string, story_id string, position int, prompt_tokens int"
    )
    kept = requests.context_guard(requests.requests(requests.with_token_counts(pos, counts)))
    assert kept.count() == 79
    assert kept.filter("run = 'olmo3_base' AND position = 4").isEmpty()


def test_export_carries_prompt_or_messages(spark, stories):
    open_ = study.open_requests(stories)
    out = prompts.export_prompts(open_, study.story_texts(stories)).collect()
    assert len(out) == 80
    for r in out:
        assert (r.prompt is None) != (r.messages is None)
        assert r.n_continuations == 5 and r.temperature == 1.2 and r.top_p == 0.95
    by_run = {r.run: r.enable_thinking for r in out}
    assert by_run["qwen3_32b_thinking"] is True
    assert by_run["qwen3_32b_nothinking"] is False
    assert by_run["qwen25_32b_instruct"] is None


def test_own_registry(spark, stories):
    registry = [Model("mine", is_base=True), Model("other", is_reasoning=True)]
    runs = [Run(1, "a", "mine"), Run(2, "b", "other", thinking=True, max_tokens_mult=2.0)]
    rows = requests.requests(study.story_positions(stories), runs, registry).collect()
    assert {(r.run, r.prompt_mode, r.strip_think) for r in rows} == {("a", "base_raw", False), ("b", "chat", True)}
