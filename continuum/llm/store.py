"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from continuum.sources.shared import fresh_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet: a lost executor costs a reread, not a recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The rows, written once in buckets of ``keys``, so that joins on them move only the other side."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt(df.repartition(n, *keys), name, keys)


def dealt(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """``bucketed`` for rows that a grouping by ``keys`` has dealt out already: they do not move again."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", fresh_path(spark, name))
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).saveAsTable(table)
    rows = spark.table(table)
    rows.schema  # resolved now, so the catalogue entry has done its work; the files stay
    spark.sql(f"DROP TABLE {table}")
    return rows


_shipped: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package: it is sent to them as an archive, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="continuum-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
