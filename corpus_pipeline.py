"""Documents to packed training sequences: each stage is written as Parquet and read again.

The stages clean lines and drop poor documents, keep one document of each near-duplicate class,
cut out long strings that occur more than once, repeat sources towards their weights, and pack
what is left. The first four return the columns of ``documents``; a text whose parts were
removed keeps its row, and ``n_chars`` follows the text.

Defined results: a null or empty text fails the quality rules and goes, as do texts of under 20
words; equal documents, whatever their ids, are one class and the least id stays, of equal rows
one; null ids and null sources pass through, a null source being a source of its own; columns
beyond those of ``documents`` are kept until packing; an empty table gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from continuum.llm import minhash, mixing, packing, quality, suffix
from continuum.llm.store import importable, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return minhash.one_per_class(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return suffix.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.remixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    pieces = packing.pieces(docs)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.placed(digests)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("source_mix", source_mix),
    ("packed", packed),
]

#: DuckDB has no counterpart of the near-duplicate, repeated-string and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
