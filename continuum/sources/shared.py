"""The folder all executors share, for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session may fall back to a temp folder."""
    sc = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="continuum-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is ever overwritten."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of the executors that made them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at the path, on whatever file system it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
