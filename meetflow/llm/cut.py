"""Cutting lineage through the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(top or tempfile.mkdtemp(prefix="meetflow-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: computed once, readable after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, and its path.

    For loops: unlike a checkpoint it carries no constraints of the plans before
    it, which grow from round to round, and it can be removed at once.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
