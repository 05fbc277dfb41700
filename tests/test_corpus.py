"""Folders of text files and table corpora."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from continuum.functions import text
from continuum.operators import filters, progress
from continuum.plans import study
from continuum.sources import corpus


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    files = {
        "00001.txt": b"One.\r\nTwo.\rThree. ",
        "00002.txt": b"\xef\xbb\xbfBom stays.",
        "00003.txt": b"bad \xff byte",
        "x.txt.txt": b"later name wins",
        "x.txt": b"shadowed",
        "n.md": b"not a story",
        "UPPER.TXT": b"suffix is case-sensitive",
        "00250.txt": b"beyond the id range",
    }
    for name, body in files.items():
        (d / name).write_bytes(body)
    (d / "nested").mkdir()
    (d / "nested" / "00009.txt").write_bytes(b"not read")
    return str(d)


def test_reads_whole_files_by_suffix(spark, folder):
    rows = {r.story_id: r.text for r in corpus.read_text_corpus(spark, folder).collect()}
    assert set(rows) == {"00001", "00002", "00003", "00250", "x"}
    assert rows["00001"] == "One.\r\nTwo.\rThree. "
    assert rows["00002"] == "﻿Bom stays."
    assert rows["00003"] == "bad � byte"
    assert rows["x"] == "later name wins"


def test_folder_keeps_every_story(spark, tmp_path):
    d = tmp_path / "odd [x] {y}"
    (d / "k=1").mkdir(parents=True)
    for name, body in {"00001.txt": "One.", "00002.txt": "", "a b+%c.txt": "Odd name."}.items():
        (d / name).write_text(body, encoding="utf-8")
    (d / "k=1" / "00009.txt").write_text("nested", encoding="utf-8")
    want = {"00001": "One.", "00002": "", "a b+%c": "Odd name."}
    for strict in (False, True):
        got = corpus.read_text_corpus(spark, str(d), strict=strict).collect()
        assert {r.story_id: r.text for r in got} == want
        assert len({r.source_file.rpartition("/")[0] for r in got}) == 1
    assert {r.story_id for r in corpus.list_text_corpus(spark, str(d)).collect()} == set(want)
    counts = progress.funnel_counts(corpus.read_text_corpus(spark, str(d))).first()
    assert counts is not None
    (d / "_hid.txt").write_text("x", encoding="utf-8")
    with pytest.raises(ValueError, match="hidden"):
        corpus.read_text_corpus(spark, str(d))


def test_repeated_ids_are_found(spark):
    rows = spark.createDataFrame([("1", "f", "a"), ("1", "g", "b"), ("2", "f", "c")], "story_id string, source_file string, text string")
    with pytest.raises(ValueError, match="'1' occurs 2 times"):
        corpus.require_unique(rows)
    assert corpus.require_unique(rows.filter("text <> 'b'")).count() == 2


def test_cleaning_normalises_newlines(spark, folder):
    df = corpus.read_text_corpus(spark, folder).filter("story_id = '00001'")
    assert df.select(text.clean(F.col("text"))).first()[0] == "One.\nTwo.\nThree."


def test_strict_reading_rejects_bad_bytes(spark, folder):
    strict = corpus.read_text_corpus(spark, folder, strict=True)
    with pytest.raises(Exception, match="UTF"):
        strict.select("text").collect()
    assert strict.filter("story_id = '00002'").first().text == "﻿Bom stays."


def test_bad_bytes_are_flagged(spark, folder):
    assert [r.story_id for r in corpus.invalid_utf8_files(spark, folder).collect()] == ["00003"]


def test_listing_reads_no_content(spark, folder):
    listing = corpus.list_text_corpus(spark, folder)
    assert "Scan" not in listing._jdf.queryExecution().executedPlan().toString().replace("Scan ExistingRDD", "")
    assert listing.count() == 6


def test_id_filter_on_files(spark, folder):
    stories = corpus.read_text_corpus(spark, folder)
    kept = filters.id_range(stories, 0, 200)
    assert {r.story_id for r in kept.collect()} == {"00001", "00002", "00003"}


def files_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numFiles").value()


def test_id_filter_opens_only_matching_files(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i:05d}.txt").write_text("Some text.", encoding="utf-8")
    scanned = corpus._files(spark, str(tmp_path))  # the part of the reader that opens files
    stories = scanned.select(corpus.story_id_of(F.col("file_name")).alias("story_id"), "content")
    assert files_read(filters.id_range(stories, 5, 12)) == 7
    assert files_read(filters.id_list(stories, "3,4,99")) == 2


def test_table_round_trip_is_sorted_and_prunable(spark, folder, tmp_path):
    path = str(tmp_path / "table")
    corpus.write_table_corpus(corpus.read_text_corpus(spark, folder), path)
    back = corpus.read_table_corpus(spark, path, id_column="story_id")
    assert {r.story_id for r in back.collect()} == {"00001", "00002", "00003", "00250", "x"}


def test_min_partitions_spreads_a_small_table_only(spark, sf):
    path = f"{sf}/documents.parquet"
    plain = corpus.read_table_corpus(spark, path, id_column="doc_id")
    spread = corpus.read_table_corpus(spark, path, id_column="doc_id", min_partitions=4)
    assert spread.rdd.getNumPartitions() == 4 > plain.rdd.getNumPartitions()
    assert sorted(spread.select("story_id").collect()) == sorted(plain.select("story_id").collect())


def test_whole_study_on_files(spark, tmp_path):
    (tmp_path / "00007.txt").write_text("A one. B two. C three. D four. E five.", encoding="utf-8")
    (tmp_path / "00008.txt").write_text("Too short. Really.", encoding="utf-8")
    stories = corpus.read_text_corpus(spark, str(tmp_path))
    rows = study.story_texts(stories).orderBy("position").collect()
    assert [(r.story_id, r.position, r.target_n_words) for r in rows] == [
        ("00007", 2, 6), ("00007", 3, 4), ("00007", 4, 2)]
    assert rows[0].prefix == "A one. B two."
    assert rows[0].ground_truth_continuation == "C three. D four. E five."


def test_manifest_corpus_equals_the_folder(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    for name, content in {"00001.txt": "a", "00002.txt": "", "x y+[1].txt": "b", "a.txt": "first", "a.txt.txt": "last", "n.md": "no"}.items():
        (folder / name).write_text(content)
    (folder / "sub.txt").mkdir()
    manifest = corpus.write_manifest(spark, str(folder), str(tmp_path / "manifest"), names_per_part=2)
    assert manifest.count() == 5 and manifest.select("part").distinct().count() == 3
    got = corpus.ingest_manifest(manifest, out)
    want = {(r.story_id, r.text) for r in corpus.read_text_corpus(spark, str(folder)).collect()}
    assert {(r.story_id, r.text) for r in got.collect()} == want == {("00001", "a"), ("00002", ""), ("x y+[1]", "b"), ("a", "last")}
    (folder / "00001.txt").write_text("changed")  # parts that are complete are not read again
    assert {(r.story_id, r.text) for r in corpus.ingest_manifest(manifest, out).collect()} == want
    (folder / ".h.txt").write_text("x")
    with pytest.raises(ValueError, match="hidden"):
        corpus.write_manifest(spark, str(folder), str(tmp_path / "again"))
