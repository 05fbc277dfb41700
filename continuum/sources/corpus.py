"""Story corpora: folders of text files, and tables.

Every reader returns ``story_id string, source_file string, text string``. The text
is raw; cleaning happens where the text is used, after the cheap filters.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from continuum.operators.joins import anti_join, semi_join
from continuum.sources.shared import path_exists

SUFFIX = ".txt"
ID_WIDTH = 5
MANIFEST_SCHEMA = "part int, file_name string, source_file string, length long"


def story_id_of(file_name: Column) -> Column:
    """File name with every ``.txt`` removed, not only the last one."""
    return F.replace(file_name, F.lit(SUFFIX), F.lit(""))


def text_glob(folder: str) -> str:
    """A path pattern for the ``*.txt`` files of one folder itself, whatever its name holds.

    A pattern, not the folder: so a sub-folder such as ``k=1`` is neither read nor taken for a
    partition. The characters of patterns in the folder's own name are escaped.
    """
    return f"{_escaped(folder.rstrip('/'))}/*{SUFFIX}"


def _escaped(path: str) -> str:
    """A path whose characters of patterns stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """``file_name, source_file, content`` of the files that hold bytes."""
    # A filter on this name is decided before the file is opened; in it, names are URL-encoded.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return spark.read.format("binaryFile").load(text_glob(folder)).select(
        name.alias("file_name"), F.col("path").alias("source_file"), "content"
    )


def refuse_hidden_names(spark: SparkSession, folder: str) -> None:
    """Raises if a scan would leave out stories whose names start with a dot or an underline."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(text_glob(folder).removesuffix(f"*{SUFFIX}") + f"[._]*{SUFFIX}")
    hidden = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    if hidden:
        raise ValueError(f"{len(hidden)} files with hidden names, such as {hidden[0].getPath().getName()}; rename them")


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """``file_name, source_file`` of all files, the empty ones too.

    The list is the one Spark's file index keeps on the driver anyway.
    """
    refuse_hidden_names(spark, folder)
    paths = [unquote(f) for f in spark.read.format("binaryFile").load(text_glob(folder)).inputFiles()]
    rows = [(p.rpartition("/")[2], re.sub(r"^(\w+:)///", r"\1/", p)) for p in paths]
    return spark.createDataFrame(rows, "file_name string, source_file string")


def _empty_files(names: DataFrame, found: DataFrame) -> DataFrame:
    """A scan has no rows for files without bytes; only names are compared to find them."""
    return names.join(found.select("file_name"), "file_name", "left_anti").withColumn("text", F.lit(""))


def empty_stories(spark: SparkSession, folder: str) -> DataFrame:
    """``story_id, source_file, text`` of the files without bytes."""
    empty = _empty_files(_names(spark, folder), _files(spark, folder))
    return empty.select(story_id_of(F.col("file_name")).alias("story_id"), "source_file", "text")


def read_text_corpus(
    spark: SparkSession,
    folder: str,
    *,
    strict: bool = False,
    resolve_collisions: bool = True,
) -> DataFrame:
    """One row per ``*.txt`` file of one folder, the whole file as the text; '' for an empty one.

    The driver lists the names once. For folders of many millions of files use ``write_manifest``
    (or an inventory) and ``ingest_manifest``, which hold the names of one part at a time.
    ``strict`` fails the job on bytes that are not UTF-8; otherwise they become
    U+FFFD. Two names can yield one id (``a.txt``, ``a.txt.txt``): the later name wins.
    Sub-folders are not read, and hidden names raise an error.
    """
    names = _names(spark, folder)
    found = _files(spark, folder)
    raw = F.col("content").cast("string")
    files = found.select(
        "file_name", "source_file", (F.validate_utf8(raw) if strict else F.make_valid_utf8(raw)).alias("text")
    )
    files = files.unionByName(_empty_files(names, found))
    if resolve_collisions:
        shadowed = _shadowed_names(names)
        if shadowed is not None:
            files = anti_join(files, shadowed, "file_name")
    return files.select(story_id_of(F.col("file_name")).alias("story_id"), "source_file", "text")


def list_text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Names and ids only; no file is opened."""
    names = _names(spark, folder).select("file_name")
    return names.withColumn("story_id", story_id_of(F.col("file_name")))


def invalid_utf8_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(story_id, source_file)`` of the files a strict read would fail on."""
    return (
        _files(spark, folder)
        .filter(~F.is_valid_utf8(F.col("content").cast("string")))
        .select(story_id_of(F.col("file_name")).alias("story_id"), "source_file")
    )


def _shadowed_names(names: DataFrame) -> DataFrame | None:
    """Files whose id is taken by a later name; None if no name can clash.

    A clash needs a name with ``.txt`` inside, so only ids of such names are looked at.
    """
    names = names.select("file_name", story_id_of(F.col("file_name")).alias("story_id"))
    odd = names.filter(F.col("file_name") != F.concat("story_id", F.lit(SUFFIX)))
    if odd.isEmpty():
        return None
    winners = (
        names.join(odd.select("story_id").distinct(), "story_id", "left_semi")
        .groupBy("story_id")
        .agg(F.max("file_name").alias("winner"))
    )
    return names.join(winners, "story_id").filter("file_name <> winner").select("file_name")


def read_table_corpus(
    spark: SparkSession,
    path: str,
    *,
    id_column: str = "story_id",
    text_column: str = "text",
    file_format: str = "parquet",
    min_partitions: int = 0,
) -> DataFrame:
    """Stories from a columnar table: the layout to use beyond a few thousand stories.

    A text id is taken as it is, a numeric one is zero-filled to the usual width. The source is
    the table's ``source_file`` column, or else the table's own path.
    A table of few files is read by few tasks; ``min_partitions`` spreads such a table, which
    is small by definition, by id. A large table has more partitions and is never shuffled.
    """
    rows = spark.read.format(file_format).load(path)
    narrow = rows.rdd.getNumPartitions() < min_partitions
    rows = table_stories(rows, path, id_column, text_column)
    return rows.repartition(min_partitions, "story_id") if narrow else rows


def table_stories(rows: DataFrame, path: str, id_column: str, text_column: str) -> DataFrame:
    """The readers' columns from a table's rows, batch or stream alike."""
    textual = isinstance(rows.schema[id_column].dataType, StringType)
    return rows.select(
        (F.col(id_column) if textual else pad_id(F.col(id_column))).alias("story_id"),
        (F.col("source_file") if "source_file" in rows.columns else F.lit(path)).alias("source_file"),
        F.col(text_column).alias("text"),
    )


def write_bucketed_corpus(stories: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """A corpus that lies in buckets of its ids, sorted, as a catalogue table; replaces an earlier one.

    Written once, it lets any number of id lists and done-sets of any size be joined without
    moving a text: the keys come to the buckets. Choose buckets so that one holds some 256 MB.
    """
    writer = stories.repartition(buckets, "story_id").write.mode("overwrite").format("parquet")
    writer.option("path", path).bucketBy(buckets, "story_id").sortBy("story_id").saveAsTable(table)
    return read_bucketed_corpus(stories.sparkSession, table)


def read_bucketed_corpus(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).select("story_id", "source_file", "text")


def write_manifest(spark: SparkSession, folder: str, path: str, *, names_per_part: int = 100_000) -> DataFrame:
    """``(part, file_name, source_file, length)`` of the ``*.txt`` files of a folder, as a table.

    The folder is listed as a stream; the driver holds the names of one part at a time, however
    many there are. Hidden names raise an error. Where an inventory of the store is at hand, make
    the table from that instead.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    listing = root.getFileSystem(conf).listStatusIterator(root)
    rows: list[tuple[int, str, str, int]] = []
    part = 0

    def flush(mode: str = "append") -> None:
        made = spark.createDataFrame(rows, MANIFEST_SCHEMA)
        made.coalesce(1).write.mode(mode).parquet(path)
        rows.clear()

    flush("overwrite")
    while listing.hasNext():
        status = listing.next()
        name = status.getPath().getName()
        if not status.isFile() or not name.endswith(SUFFIX):
            continue
        if name.startswith((".", "_")):
            raise ValueError(f"a file with a hidden name, {name}; rename it")
        rows.append((part, name, status.getPath().toString(), status.getLen()))
        if len(rows) >= names_per_part:
            flush()
            part += 1
    if rows:
        flush()
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def ingest_manifest(manifest: DataFrame, path: str, *, strict: bool = False) -> DataFrame:
    """The files of a manifest as a table corpus below ``path``, part by part.

    A part is a folder that is replaced when it is written again, and a part that is complete is
    passed over, so the work can be taken up after a failure. Spark reads the files of a part; empty
    files come from the manifest. Of names that give one id, the last in the whole manifest wins.
    """
    spark = manifest.sparkSession
    story = story_id_of(F.col("file_name"))
    odd = manifest.filter(F.col("file_name") != F.concat(story, F.lit(SUFFIX))).select(story.alias("story_id"))
    named = manifest.withColumn("story_id", story)
    # A clash needs a name with the suffix inside; only ids of such names are grouped.
    clashing = semi_join(named, odd.distinct(), "story_id").groupBy("story_id").agg(F.max("file_name").alias("winner"))
    losers = named.join(clashing, "story_id").filter("file_name <> winner").select("file_name")
    wanted = anti_join(named, losers, "file_name")
    parts = [r["part"] for r in manifest.select("part").distinct().orderBy("part").collect()]
    for part in parts:
        folder = f"{path}/part={part}"
        if path_exists(spark, f"{folder}/_SUCCESS"):
            continue
        rows = wanted.filter(F.col("part") == part)
        full = [r["source_file"] for r in rows.filter("length > 0").select("source_file").toLocalIterator()]
        empty = rows.filter("length = 0").select("story_id", "source_file", F.lit("").alias("text"))
        stories = empty
        if full:
            raw = F.col("content").cast("string")
            files = spark.read.format("binaryFile").load([_escaped(f) for f in full])
            name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
            stories = files.select(
                story_id_of(name).alias("story_id"),
                F.col("path").alias("source_file"),
                (F.validate_utf8(raw) if strict else F.make_valid_utf8(raw)).alias("text"),
            ).unionByName(empty)
        stories.write.mode("overwrite").parquet(folder)
    schema = "story_id string, source_file string, text string, part int"
    return spark.read.schema(schema).parquet(path).drop("part") if parts else spark.createDataFrame([], schema).drop("part")


def repeated_ids(stories: DataFrame) -> DataFrame:
    """``(story_id, n)`` of ids that more than one row has; texts are not read."""
    return stories.groupBy("story_id").agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(stories: DataFrame) -> DataFrame:
    """The stories; raises if an id occurs twice, as cuts and completions would mix."""
    first = repeated_ids(stories).first()
    if first is not None:
        raise ValueError(f"story_id {first['story_id']!r} occurs {first['n']} times")
    return stories


def pad_id(number: Column) -> Column:
    """A numeric id as text of at least five digits."""
    digits = number.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(ID_WIDTH) - F.length(digits), F.lit(0))), digits)


def write_table_corpus(
    stories: DataFrame, path: str, *, partitions: int | None = None, max_records_per_file: int = 0
) -> None:
    """Turn a folder of small files into a table sorted by id within range partitions.

    Sorted ids give row groups tight min/max ranges, so shards and id bounds prune. Without a
    number of partitions the session's shuffle width is used.
    """
    width = [] if partitions is None else [partitions]
    (
        stories.repartitionByRange(*width, "story_id")
        .sortWithinPartitions("story_id")
        .write.option("maxRecordsPerFile", max_records_per_file)
        .parquet(path)
    )
