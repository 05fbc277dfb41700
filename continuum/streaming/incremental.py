"""Incremental corpus: new files are processed once, earlier ones never again.

The file source's checkpoint plays the part of "skip what is written" for files; for stories it
is the output itself, as in a batch run. The transformations are the batch ones; they keep no
state across rows, so no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from continuum.operators.joins import anti_join, semi_join
from continuum.sources.corpus import (
    empty_stories,
    refuse_hidden_names,
    repeated_ids,
    story_id_of,
    table_stories,
    text_glob,
)
from continuum.sources.shared import path_exists

#: The batch of empty files, which a stream has no rows for; before any batch of the stream.
EMPTY_FILES = -1


def stream_table_corpus(
    spark: SparkSession,
    folder: str,
    schema: str | StructType,
    *,
    id_column: str = "story_id",
    text_column: str = "text",
    glob: str = "*.parquet",
    max_files_per_trigger: int = 1_000,
) -> DataFrame:
    """Stories from table files as they arrive."""
    rows = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(folder)
    )
    return table_stories(rows, folder, id_column, text_column)


def stream_text_corpus(spark: SparkSession, folder: str, *, max_files_per_trigger: int = 10_000) -> DataFrame:
    """Stories from text files as they arrive, one file each.

    A stream has no rows for files without bytes, and none for hidden names: the former are added
    by ``append_text_folder``, the latter are refused here when the stream is made.
    """
    refuse_hidden_names(spark, folder)
    files = (
        spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .format("binaryFile")
        .load(text_glob(folder))
    )
    return files.select(
        story_id_of(F.substring_index(F.col("path"), "/", -1)).alias("story_id"),
        F.col("path").alias("source_file"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )


def append_available(rows: DataFrame, output: str, checkpoint: str, *, file_format: str = "parquet") -> StreamingQuery:
    """Process what has arrived since the last call and append it, exactly once, then stop."""
    query = (
        rows.writeStream.format(file_format)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(output)
    )
    query.awaitTermination()
    return query


def append_new_stories(
    arriving: DataFrame, plan: Callable[[DataFrame], DataFrame], output: str, checkpoint: str
) -> StreamingQuery:
    """Write ``plan(stories)`` for the stories that have arrived and are not in the output yet, each once.

    ``plan`` keeps ``story_id``. A story that arrives again, in the same lot or a later one, is
    passed over: of one lot the row of the least source and text counts. Each lot is a folder
    ``batch=n`` and replaces itself when Spark repeats it after a failure, so its rows are there once.
    Only ids are compared; a text moves only where its id occurs twice in a lot.
    """

    def write(lot: DataFrame, number: int) -> None:
        _write_lot(lot, number, plan, output)

    query = (
        arriving.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def append_text_folder(
    spark: SparkSession,
    folder: str,
    plan: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    *,
    max_files_per_trigger: int = 10_000,
) -> StreamingQuery:
    """``append_new_stories`` for a folder of text files, the empty ones too; hidden names are refused."""
    arriving = stream_text_corpus(spark, folder, max_files_per_trigger=max_files_per_trigger)
    query = append_new_stories(arriving, plan, output, checkpoint)
    _write_lot(empty_stories(spark, folder), EMPTY_FILES, plan, output)
    return query


def read_lots(spark: SparkSession, output: str, schema: StructType) -> DataFrame:
    """All rows written by ``append_new_stories``; ``schema`` is that of the plan."""
    if not path_exists(spark, output):
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType([*schema, StructField("batch", IntegerType())])).parquet(output).drop("batch")


def _write_lot(lot: DataFrame, number: int, plan: Callable[[DataFrame], DataFrame], output: str) -> None:
    spark = lot.sparkSession
    again = repeated_ids(lot).select("story_id")
    order = Window.partitionBy("story_id").orderBy("source_file", "text")
    several = semi_join(lot, again, "story_id").withColumn("_n", F.row_number().over(order))
    stories = anti_join(lot, again, "story_id").unionByName(several.filter("_n = 1").drop("_n"))
    if path_exists(spark, output):
        written = spark.read.schema("story_id string, batch int").parquet(output)
        stories = anti_join(stories, written.filter(F.col("batch") != number).select("story_id").distinct(), "story_id")
    plan(stories).write.mode("overwrite").parquet(f"{output}/batch={number}")
