"""Incremental corpus: arriving files give the same rows as one batch, each file once."""

from __future__ import annotations

import pytest

from continuum.plans import study
from continuum.sources.corpus import read_table_corpus, read_text_corpus
from continuum.streaming import incremental


def test_text_files_arrive_in_two_lots(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()

    def add(name, n):
        (folder / name).write_text(" ".join(f"S{i} says hi." for i in range(n)), encoding="utf-8")

    def step():
        rows = study.story_positions(incremental.stream_text_corpus(spark, str(folder), max_files_per_trigger=1))
        incremental.append_available(rows, out, mark)
        return spark.read.parquet(out)

    add("00001.txt", 10)
    add("00002.txt", 4)
    assert step().count() == 4
    add("00003.txt", 5)
    add("00004.txt", 30)
    second = step()
    assert second.count() == 4 + 3 + 4
    batch = study.story_positions(read_text_corpus(spark, str(folder)))
    assert sorted(second.collect()) == sorted(batch.collect())
    assert step().count() == 11  # nothing new, nothing twice


def test_table_stream_equals_batch_for_text_ids(spark, tmp_path):
    folder = str(tmp_path / "table")
    text = "A one. B two. C three. D four. E five."
    rows = spark.createDataFrame([("42", text), ("x7", text)], "story_id string, text string")
    rows.write.parquet(folder)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    stream = incremental.stream_table_corpus(spark, folder, rows.schema)
    incremental.append_available(stream, out, mark)
    arrived = spark.read.parquet(out)
    batch = read_table_corpus(spark, folder)
    assert sorted(arrived.collect()) == sorted(batch.collect())
    assert {r.story_id for r in arrived.collect()} == {"42", "x7"}
    none = spark.createDataFrame([], "run string, story_id string, position int, sample_idx int, raw_text string")
    assert study.story_records(arrived, none, complete=False).count() == 2 * 20


def test_a_story_that_arrives_again_is_written_once(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    text = " ".join(f"S{i} says hi." for i in range(10))
    schema = "story_id string, text string"
    plan = study.story_positions

    def deliver(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / name))

    def step(checkpoint=mark):
        stream = incremental.stream_table_corpus(spark, f"{folder}/*", schema, max_files_per_trigger=1)
        incremental.append_new_stories(stream, plan, out, checkpoint)
        return incremental.read_lots(spark, out, plan(spark.createDataFrame([], "story_id string, source_file string, text string")).schema)

    deliver("a", [("00001", text), ("00001", text), ("00002", text)])
    assert step().count() == 8
    deliver("b", [("00001", "Else. " + text), ("00003", text), ("00004", "Too short.")])
    assert step().count() == 12
    assert step(str(tmp_path / "lost")).count() == 12  # the checkpoint is lost: everything arrives again
    (first,) = {r.n_context_sentences for r in step().filter("story_id = '00001' AND position = 9").collect()}
    assert first == 9


def test_a_lot_that_is_repeated_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("1", "f", "x"), ("2", "f", "y")], "story_id string, source_file string, text string")
    for _ in range(2):
        incremental._write_lot(rows, 0, lambda s: s, out)
    incremental._write_lot(rows.unionByName(rows.withColumn("story_id", rows.story_id + 5)), 1, lambda s: s, out)
    assert incremental.read_lots(spark, out, rows.schema).count() == 4


def test_text_folder_keeps_empty_files_and_refuses_hidden_names(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    (folder / "00001.txt").write_text("One.")
    (folder / "00003.txt").write_text("")
    same = lambda stories: stories.select("story_id", "text")
    schema = spark.createDataFrame([], "story_id string, text string").schema
    for _ in range(2):
        incremental.append_text_folder(spark, str(folder), same, out, mark)
        got = {r.story_id: r.text for r in incremental.read_lots(spark, out, schema).collect()}
        assert got == {"00001": "One.", "00003": ""}
    assert incremental.read_lots(spark, out, schema).count() == 2
    (folder / "_hid.txt").write_text("Hidden.")
    with pytest.raises(ValueError, match="hidden"):
        incremental.append_text_folder(spark, str(folder), same, out, mark)
