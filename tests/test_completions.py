"""Completions, records, fine-tuning rows, comparison and checks."""

from __future__ import annotations

import json
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from continuum.config import CURRENT, OLD
from continuum.functions import text
from continuum.functions.text import WHITESPACE
from continuum.operators import checks, compare, completions, progress
from continuum.operators.requests import KEYS
from continuum.plans import study
from continuum.sources import results
from continuum.sources.catalogue import COMPARISON_GROUPS, RUNS
from tests.conftest import plan_of

TEN = " ".join(f"S{i} word here." for i in range(10))
FIVE = "A one. B two. C three. D four. E five."
RAW = "run string, story_id string, position int, sample_idx int, raw_text string"
THINKS, PLAIN, ALWAYS_OFF = "qwen3_32b_thinking", "qwen25_32b_base", "qwen3_32b_nothinking"


@pytest.fixture(scope="module")
def stories(spark):
    rows = [("00001", "f1", TEN), ("00002", "f2", FIVE), ("00003", "f3", "Too short.")]
    return spark.createDataFrame(rows, "story_id string, source_file string, text string")


@pytest.fixture(scope="module")
def raw(spark, stories):
    """Five samples for every open request, answered out of order and some twice."""
    text = F.concat_ws(" ", F.lit("<think>plan</think> "), F.lit("out"), "run", "position", "sample_idx")
    open_ = study.open_requests(stories).withColumn("sample_idx", F.explode(F.expr("sequence(4, 0, -1)")))
    rows = open_.select(*KEYS, "sample_idx", text.alias("raw_text"))
    return rows.unionByName(rows.filter("sample_idx = 2"))


def test_only_thinking_runs_are_stripped(spark):
    rows = [(r, "1", 1, 0, " <think>x</think> y ") for r in (THINKS, PLAIN, ALWAYS_OFF)]
    got = {r.run: r.continuation for r in completions.clean_completions(spark.createDataFrame(rows, RAW)).collect()}
    assert got == {THINKS: "y", PLAIN: "<think>x</think> y", ALWAYS_OFF: "<think>x</think> y"}


def test_attach_orders_samples_and_folds_copies(spark, stories, raw):
    attached = study.answered_requests(stories, raw)
    assert attached.count() == 7 * 20
    for r in attached.collect():
        assert len(r.continuations) == 5
        assert [c.split()[-1] for c in r.continuations] == list("01234")


def test_one_delivery_of_a_sample_counts(spark, stories, raw):
    """Differing, missing and out-of-range deliveries: every table keeps the same samples."""
    here = f"run = '{PLAIN}' AND story_id = '00001' AND position = 4"
    again = raw.filter(f"{here} AND sample_idx = 0").withColumn("raw_text", F.lit("!!! first in order"))
    beyond = raw.filter(f"{here} AND sample_idx = 4").withColumn("sample_idx", F.lit(7))
    faulty = raw.filter(f"NOT ({here} AND sample_idx = 2)").unionByName(again).unionByName(beyond)
    attached = study.answered_requests(stories, faulty)
    rows = {r.sample_idx: r.continuation for r in completions.sample_rows(attached.filter(here)).collect()}
    assert set(rows) == {0, 1, 3, 4} and rows[0] == "!!! first in order"
    order = [*KEYS, "sample_idx"]
    tuned = study.finetuning(stories, faulty)
    by_cut = completions.finetune_rows(completions.clean_completions(faulty), study.story_texts(stories))
    assert tuned.orderBy(order).collect() == by_cut.orderBy(order).collect()
    keyed = [*order, "continuation"]
    assert tuned.select(keyed).orderBy(order).collect() == (
        completions.sample_rows(attached).select(keyed).orderBy(order).collect()
    )
    faults = by_subject(checks.check_output_count(study.open_requests(stories), faulty).filter("check = 'output_count'"))
    assert faults[PLAIN] == (1, "fail") and faults[THINKS] == (0, "pass")
    assert study.story_records(stories, faulty).count() == 39
    kept = study.story_records(stories, faulty, complete=False).filter(f"run = '{PLAIN}' AND story_id = '00001'").first()
    assert [len(p.continuations) for p in kept.positions] == [4, 5, 5, 5]


def test_records_resume(spark, stories, raw, tmp_path):
    """Write, resume, write: nothing is lost, doubled or done before it is complete."""
    out = str(tmp_path / "records")
    part = raw.filter("story_id = '00001' OR sample_idx < 3")
    none = spark.createDataFrame([], RAW)
    assert study.story_records(stories, none).isEmpty()
    results.write_records(study.story_records(stories, part), out, file_format="parquet")
    done = results.done_set(results.read_records(spark, out, file_format="parquet"))
    assert {r.story_id for r in done.collect()} == {"00001"}
    assert study.pending_requests(stories, done).select("story_id").distinct().collect() == [("00002",)]
    results.write_records(study.story_records(stories, raw, done=done), out, file_format="parquet")
    back = results.read_records(spark, out, file_format="parquet")
    assert back.count() == back.select("run", "story_id").distinct().count() == 40
    assert study.pending_requests(stories, results.done_set(back)).isEmpty()


def test_unanswered_request_keeps_an_empty_array(spark, stories, raw):
    missing = raw.filter(f"NOT (run = '{PLAIN}' AND story_id = '00001' AND position = 4)")
    row = study.answered_requests(stories, missing).filter("size(continuations) = 0").collect()
    assert [(r.run, r.story_id, r.position) for r in row] == [(PLAIN, "00001", 4)]


def test_records_have_every_field(spark, stories, raw):
    records = study.story_records(stories, raw)
    assert records.count() == 2 * 20
    r = records.filter(f"run = '{THINKS}' AND story_id = '00001'").first()
    assert (r.source_file, r.n_sentences, r.n_words, r.n_positions_evaluated) == ("f1", 10, 30, 4)
    assert (r.model, r.prompt_mode, r.thinking_enabled) == ("Qwen/Qwen3-32B", "chat", True)
    assert (r.tensor_parallel_size, r.quantization, r.max_tokens_mult) == (1, None, 2.0)
    assert r.position_pcts_config == [0.4, 0.6, 0.8, 0.9] and r.n_continuations_per_position == 5
    assert [p.position for p in r.positions] == [4, 6, 8, 9]
    first = r.positions[0]
    assert (first.n_context_sentences, first.n_remaining_sentences) == (4, 6)
    assert (first.pct_story_revealed, first.target_n_words) == (40.0, 18)
    assert first.prefix + " " + first.ground_truth_continuation == TEN
    assert first.continuations == [f"out {THINKS} 4 {i}" for i in range(5)]


def test_record_schema_matches_the_reader(spark, stories, raw):
    made = study.story_records(stories, raw).schema
    read = spark.createDataFrame([], results.RECORD_SCHEMA).schema
    assert {f.name: f.dataType.simpleString() for f in made} == {f.name: f.dataType.simpleString() for f in read}


def test_record_without_surviving_position_is_kept(spark, stories, raw):
    tight = replace(CURRENT, context_length=120)
    records = study.story_records(stories, raw, config=tight)
    assert records.count() == 40
    gone = records.filter("size(positions) = 0")
    assert gone.count() > 0
    assert {r.n_positions_evaluated for r in gone.collect()} <= {3, 4}


def test_json_sink_round_trip(spark, stories, raw, tmp_path):
    out = str(tmp_path / "records")
    records = study.story_records(stories, raw)
    results.write_records(records, out)
    back = results.read_records(spark, out)
    order = ["run", "story_id"]
    columns = sorted(records.columns)
    assert (back.select(columns).orderBy(order).collect() == records.select(columns).orderBy(order).collect())
    line = json.loads(next(next(Path(out).glob(f"run={PLAIN}")).glob("*.json")).read_text().splitlines()[0])
    assert "quantization" in line and line["quantization"] is None
    counts = {r.run: r.n for r in results.progress_by_run(results.done_set(back)).collect()}
    assert counts == {r.run: 2 for r in RUNS}


def test_parquet_working_table_feeds_resume(spark, stories, raw, tmp_path):
    out = str(tmp_path / "table")
    results.write_records(study.story_records(stories, raw), out, file_format="parquet")
    done = results.done_set(results.read_records(spark, out, file_format="parquet"))
    counts = {r.run: tuple(r)[1:] for r in progress.progress_counts(stories, done).collect()}
    assert counts == {r.run: (0, 2, 1) for r in RUNS}


def test_finetune_rows(spark, stories, raw, tmp_path):
    rows = completions.finetune_rows(completions.clean_completions(raw), study.story_texts(stories))
    assert rows.count() == 7 * 20 * 5
    assert rows.filter(F.concat_ws(" ", "prefix", "ground_truth_continuation") == TEN).count() == 400
    results.write_finetune(rows, str(tmp_path / "ft"))
    assert spark.read.json(str(tmp_path / "ft")).count() == 700


def test_compare_pairs_and_stages(spark, stories, raw):
    cleaned = completions.clean_completions(raw)
    pairs = compare.compare_pairs(cleaned, CURRENT)
    assert pairs.count() == 6 * 7
    r = pairs.filter("group_id = 'qwen3_thinking' AND story_id = '00001' AND position = 4").first()
    assert r.right == [f"out {THINKS} 4 {i}" for i in range(5)]
    assert all(t.startswith("<think>plan</think>") for t in r.left)
    stages = compare.compare_stages(cleaned, CURRENT)
    assert stages.count() == 2 * 7
    assert {m.group_id for m in COMPARISON_GROUPS if m.kind == "stages"} == {
        x.group_id for x in stages.select("group_id").distinct().collect()
    }


def test_compare_needs_every_side(spark, stories, raw):
    cleaned = completions.clean_completions(raw).filter("NOT (run = 'olmo3_base' AND position = 4)")
    assert compare.compare_stages(cleaned, CURRENT).filter("position = 4").isEmpty()
    assert compare.compare_pairs(cleaned, CURRENT).count() == 42


def by_subject(df):
    return {r.subject: (r.n, r.status) for r in df.collect()}


def test_output_checks(spark, stories, raw):
    open_ = study.open_requests(stories)
    assert set(by_subject(checks.check_output_count(open_, raw)).values()) == {(0, "pass")}
    less = raw.filter(f"NOT (run = '{PLAIN}' AND position = 4 AND sample_idx = 0)")
    faults = by_subject(checks.check_output_count(open_, less).filter("check = 'output_count'"))
    assert faults[PLAIN] == (2, "fail") and faults[THINKS] == (0, "pass")
    bad = spark.createDataFrame(
        [(THINKS, "1", 1, 0, "a</think> "), (THINKS, "1", 1, 1, "<think>b"), (PLAIN, "1", 1, 0, "fine")], RAW
    )
    cleaned = completions.clean_completions(bad)
    assert by_subject(checks.check_empty_output(cleaned)) == {THINKS: (1, "fail"), PLAIN: (0, "pass")}
    assert by_subject(checks.check_think_leak(cleaned)) == {THINKS: (1, "fail"), PLAIN: (0, "pass")}


def test_model_class_check(spark, stories):
    open_ = study.open_requests(stories)
    assert {s for _, s in by_subject(checks.check_model_class(open_)).values()} == {"pass"}
    wrong = open_.withColumn(
        "prompt_mode", F.when(F.col("model") == "Qwen/QwQ-32B", "base_raw").otherwise(F.col("prompt_mode"))
    )
    assert by_subject(checks.check_model_class(wrong))["Qwen/QwQ-32B"][1] == "fail"
    nothing = by_subject(checks.check_model_class(open_.filter("false")))
    assert set(nothing.values()) == {(0, "fail")} and len(nothing) == 18
    assert not checks.passed(checks.check_summary([checks.check_model_class(open_)]).filter("false"))
    unknown = open_.withColumn("model", F.lit("made/up"))
    assert by_subject(checks.check_model_class(unknown))["made/up"][1] == "fail"


def test_prompt_check(spark, stories):
    good = study.export_requests(stories)
    assert {s for _, s in by_subject(checks.check_prompts(good)).values()} == {"pass"}
    chat, here = F.col("messages"), F.col("run") == "qwen25_32b_instruct"
    system = F.array(chat[0])
    user = F.struct(chat[1]["role"].alias("role"), F.concat(chat[1]["content"], F.lit(" </THINK>")).alias("content"))
    faults = {
        "tag": good.withColumn("messages", F.when(chat.isNotNull(), F.array(chat[0], user))),
        "one message": good.withColumn("messages", F.when(here, system).otherwise(chat)),
        "no message": good.withColumn("messages", F.when(~here, chat)),
        "both": good.withColumn("prompt", F.when(here, F.lit("x")).otherwise(F.col("prompt"))),
    }
    for name, rows in faults.items():
        got = by_subject(checks.check_prompts(rows))
        assert got["qwen25_32b_instruct"] == (7, "fail"), name
        assert got[THINKS] == (0, "pass") and got[PLAIN] == (0, "pass"), name
    empty = good.withColumn("prompt", F.when(F.col("prompt").isNotNull(), F.lit(" ")))
    assert by_subject(checks.check_prompts(empty))[PLAIN] == (7, "fail")


def test_missing_runs_and_summary(spark):
    done = spark.createDataFrame([(PLAIN, "1"), (PLAIN, "2")], "run string, story_id string")
    missing = checks.check_missing_runs(done)
    assert by_subject(missing)[PLAIN] == (2, "pass")
    assert checks.missing_runs(done).count() == 19
    summary = checks.check_summary([missing, missing.filter("status = 'pass'")])
    assert {(r.check, r.status): r.n for r in summary.collect()} == {
        ("missing_runs", "pass"): 2, ("missing_runs", "fail"): 19}
    assert not checks.passed(summary)
    assert checks.passed(summary.filter("status = 'pass'"))


def test_a_flood_of_copies_of_one_sample_changes_nothing(spark, stories, raw):
    one = raw.filter(f"run = '{THINKS}' AND story_id = '00001' AND position = 4 AND sample_idx = 3")
    copies = one.limit(1).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("i")
    flooded = raw.unionByName(copies)
    assert flooded.count() > 1.5 * raw.count()
    order = ["run", "story_id", "position"]
    columns = [*order, "continuations"]

    def answers(rows):
        return study.answered_requests(stories, rows).select(columns).orderBy(order).collect()

    assert answers(flooded) == answers(raw)
    sizes = study.story_records(stories, flooded).select(F.flatten("positions.continuations").alias("c"))
    assert {len(r.c) for r in sizes.collect()} == {15, 20}


TRIES = "run string, story_id string, position int, sample_idx int, delivery long, raw_text string"


def folded(spark, tries, schema=TRIES):
    rows = [(PLAIN, "00001", 4, *t) for t in tries]
    cleaned = completions.clean_completions(spark.createDataFrame(rows, schema))
    found = completions.gather_samples(cleaned, 5).collect()
    return {s.sample_idx: s.continuation for r in found for s in r.samples}


def test_a_retry_mends_an_empty_delivery(spark):
    tries = [(0, 0, ""), (0, 1, "A real answer."), (1, 5, "late"), (1, 2, "early"), (2, 0, "text"), (2, 3, " "),
             (3, None, "a"), (3, None, "b"), (4, None, "zz"), (4, 0, "z")]
    assert folded(spark, tries) == {0: "A real answer.", 1: "late", 2: "text", 3: "a", 4: "z"}
    plain = [(0, ""), (0, "A real answer."), (1, ""), (2, "b"), (2, "a"), (3, None), (9, "x")]
    assert folded(spark, plain, RAW) == {0: "A real answer.", 1: "", 2: "a"}


def test_a_crowded_request_is_folded_before_it_moves(spark):
    tries = [(0, i, f"try {i}") for i in range(150)]
    assert completions.crowded(spark.createDataFrame([(1,)] * 150, "story_id int"), ["story_id"], 5)
    assert folded(spark, tries) == {0: "try 149"}


def test_comparison_keeps_all_samples_of_the_older_preset(spark):
    rows = [(r, "1", 1, i, f"{r} {i}") for r in (PLAIN, "qwen25_32b_instruct") for i in range(20)]
    cleaned = completions.clean_completions(spark.createDataFrame(rows, RAW))
    (pair,) = compare.compare_pairs(cleaned, OLD).collect()
    assert [len(pair.left), len(pair.right)] == [20, 20] and pair.left[19] == f"{PLAIN} 19"
    with pytest.raises(TypeError):
        compare.compare_pairs(cleaned)


def test_orphan_deliveries_fail(spark, stories, raw):
    open_ = study.open_requests(stories)
    strange = [("nobody", "00001", 4, 0, "x"), (PLAIN, "99999", 4, 0, "x"), (PLAIN, "00001", 5, 0, "x"), (PLAIN, "00001", 5, 1, "y")]
    found = checks.check_output_count(open_, raw.unionByName(spark.createDataFrame(strange, RAW))).collect()
    got = {(r.check, r.subject): (r.n, r.status) for r in found}
    assert got["orphan_output", PLAIN] == (2, "fail") and got["orphan_output", "nobody"] == (1, "fail")
    assert got["orphan_output", THINKS] == (0, "pass") and got["output_count", PLAIN] == (0, "pass")
    assert ("output_count", "nobody") not in got
    again = raw.withColumn("delivery", F.lit(1).cast("long")).unionByName(raw.withColumn("delivery", F.lit(0).cast("long")).withColumn("raw_text", F.lit("")))
    assert {r.status for r in checks.check_output_count(open_, again).collect()} == {"pass"}


def test_supplied_counts_agree_everywhere(spark, stories, raw):
    counts = spark.createDataFrame(
        [(PLAIN, "00001", 4, 40000), (PLAIN, "00001", 4, 39999), (THINKS, "00002", 2, 99999), (PLAIN, "00002", 2, 1), ("nobody", "00001", 4, 9)],
        "run string, story_id string, position int, prompt_tokens int",
    )
    open_ = study.open_requests(stories, token_counts=counts)
    keys = lambda df: sorted(map(tuple, df.select(*KEYS).collect()))
    assert open_.count() == 138 and (PLAIN, "00001", 4) not in keys(open_)
    assert {r.prompt_tokens_est for r in open_.filter(f"run = '{PLAIN}' AND story_id = '00002' AND position = 2").collect()} == {1}
    assert keys(study.export_requests(stories, token_counts=counts)) == keys(open_)
    none = spark.createDataFrame([], "run string, story_id string")
    assert keys(study.pending_requests(stories, none, token_counts=counts)) == keys(open_)
    records = study.story_records(stories, raw, token_counts=counts)
    assert keys(records.select("run", "story_id", F.explode("positions.position").alias("position"))) == keys(open_)
    assert keys(study.answered_requests(stories, raw, token_counts=counts)) == keys(open_)


def test_a_repeated_commit_changes_nothing(spark, stories, raw, tmp_path):
    out = str(tmp_path / "records")
    assert results.read_committed(spark, out).isEmpty() and results.committed(spark, out).isEmpty()
    records = study.story_records(stories, raw)
    for batch in ("0001", "0001", "0002"):
        told = results.commit_records(records.filter("story_id = '00001'") if batch == "0001" else records, out, batch)
    back = results.read_committed(spark, out)
    assert back.count() == 40 and back.select("run", "story_id").distinct().count() == 40
    assert sorted(back.select(sorted(records.columns)).collect()) == sorted(records.select(sorted(records.columns)).collect())
    assert {(r.check, r.status, r.n) for r in told.collect() if r.check == "missing_runs"} == {("missing_runs", "pass", 1)}
    # A write that was cut off before its commit is not read, and is replaced when it is repeated.
    results.write_records(records, f"{out}/batch=0003")
    assert results.read_committed(spark, out).count() == 40
    assert study.pending_requests(stories, results.committed(spark, out)).isEmpty()
    with pytest.raises(ValueError):
        results.commit_records(records, out, "a/b")


def test_checks_on_the_way_to_the_sink(spark, stories, raw, tmp_path):
    """The tally of the write equals that of queries over what was written, with one read of the records."""
    bad = raw.withColumn("raw_text", F.when((F.col("run") == PLAIN) & (F.col("position") == 4), "a</think>")
                         .when((F.col("run") == "olmo3_base") & (F.col("sample_idx") == 1), " ").otherwise(F.col("raw_text")))
    faulty = bad.filter(f"NOT (run = '{THINKS}' AND story_id = '00002' AND sample_idx = 0)").filter("run <> 'qwq_32b'")
    records = study.story_records(stories, faulty, complete=False).filter("run <> 'qwq_32b'")
    out = str(tmp_path / "records")
    told = {(r.check, r.subject): (r.n, r.status) for r in results.commit_records(records, out, "a").collect()}
    back = results.read_committed(spark, out)
    samples = back.select("run", F.explode("positions").alias("p")).select("run", F.explode("p.continuations").alias("continuation"))
    for r in checks.check_output_texts(samples).collect():
        assert told[r.check, r.subject] == (r.n, r.status)
    assert told["think_leak", PLAIN] == (35, "fail")  # a run that does not think keeps its tags
    assert told["empty_output", "olmo3_base"] == (7, "fail")
    assert told["output_count", THINKS] == (3, "fail") and told["output_count", PLAIN] == (0, "pass")
    assert told["missing_runs", "qwq_32b"] == (0, "fail") and told["missing_runs", PLAIN] == (2, "pass")
    observation = Observation()
    plan = plan_of(checks.observed(spark.read.schema(results.RECORD_SCHEMA).json(f"{out}/batch=a"), observation))
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "CollectMetrics" in plan


def test_expected_constants():
    """What the SQL counterparts take from the library, stated once more."""
    assert (CURRENT.position_pcts, CURRENT.n_continuations, CURRENT.max_words) == ((0.40, 0.60, 0.80, 0.90), 5, 5000)
    assert (OLD.position_pcts, OLD.n_continuations) == ((0.20, 0.40, 0.60, 0.80, 0.90), 20)
    assert (CURRENT.context_length, CURRENT.token_floor, CURRENT.token_clamp) == (32768, 100, 4096)
    assert (CURRENT.thinking_tokens, CURRENT.thinking_clamp, CURRENT.tokens_per_word) == (2048, 8192, 1.3)
    assert len(RUNS) == 20 and {r.max_tokens_mult for r in RUNS if r.thinking} == {2.0}
    assert sum(r.thinking for r in RUNS) == 6 and {r.max_tokens_mult for r in RUNS if not r.thinking} == {1.3}
    assert len(WHITESPACE) == 29 and all(c.isspace() for c in WHITESPACE)


def test_cleaning_in_steps_equals_the_single_expression(spark):
    run = THINKS
    texts = [
        None, "", " ", "a ", "a\u00a0", "a\u3000\u2003 ", "a\u0085", "\u1680a\u3002", "é", "à", "x\u202f", "x\u205f", "x\u2029",
        "<think>a</think> b ", "<THINK>a</Think>", "a</think>b</think> c\t", "x <think>a</think> ", "<think>open ", "a</b> ",
        "p<<think>q</think>/think>z ", "</thi<think>x</think>nk> y", "<thınK>x</THİNK> y",
    ]
    rows = [(r, str(i), 1, 0, t) for r in (run, PLAIN) for i, t in enumerate(texts)]
    raw = spark.createDataFrame(rows, RAW)
    t = F.col("raw_text")
    paired = F.regexp_replace(t, f"(?s){text.THINK_OPEN}.*?{text.THINK_CLOSE}", "")
    answer = F.when(F.col("run") == run, F.element_at(F.split(paired, text.THINK_CLOSE, 2), -1)).otherwise(t)
    plain = raw.select("run", "story_id", F.trim(answer, F.lit(text.WHITESPACE)).alias("c"))
    cleaned = completions.clean_completions(raw)
    assert sorted(map(str, cleaned.select("run", "story_id", F.col("continuation").alias("c")).collect())) == sorted(map(str, plain.collect()))
    plan = plan_of(cleaned.filter("story_id = '1'"))
    assert plan.count("regexp_replace") == 1 and "cast(_answer" in plan  # the end is told from one byte
