"""Registered queries against their SQL; the pipeline against its stages."""

from __future__ import annotations

import pytest

import corpus_pipeline
from continuum.llm.oracle import ORACLE_SQL
from continuum.llm.queries import QUERIES
from workload import compare


@pytest.fixture(scope="module")
def con(sf):
    return compare.duck(sf)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, sf, name):
    mine, theirs = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert dict(mine.dtypes) == {c: theirs.dtypes[c] for c in mine.columns} and len(mine) > 0
    assert compare.canonical(mine).equals(compare.canonical(theirs))


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packed" and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        docs = spark.createDataFrame(out.toPandas().astype(object), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    want = packed.groupBy("doc_id", "piece", "start", "length", "ids_crc32").count()
    got = corpus_pipeline.run(spark, sf).groupBy("doc_id", "piece", "start", "length", "ids_crc32").count()
    assert sorted(got.collect()) == sorted(want.collect())


def test_stages_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    """Nulls, repeated rows, clashing names and nothing at all, from stage to stage."""
    copies = odd.unionByName(odd.withColumn("doc_id", odd["doc_id"] + 100))
    for name, docs in (("odd", copies), ("none", none)):
        seen = set()
        for stage, run in corpus_pipeline.STAGES[:-1]:
            out = run(spark, docs, "")
            assert out.columns == docs.columns
            path = str(tmp_path / name / stage)
            out.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            seen.add(docs.count())
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert bool(packed) == (name == "odd") and {r.offset + r.length <= 2048 for r in packed} <= {True}
        assert name == "odd" or seen == {0}
    kept = corpus_pipeline.STAGES[1][1](spark, corpus_pipeline.STAGES[0][1](spark, copies, ""), "")
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {1, 4, None, 2**53 + 1, 5}
