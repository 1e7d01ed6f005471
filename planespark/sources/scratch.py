"""Folders for written tables and stream checkpoints, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

#: Spark's setting by which the shuffle files of an execution go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Where that is unset, a session on this machine alone (tests) gets a
    temporary folder; on a cluster, whose machines would each write to a disk
    of their own, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="planespark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession, run: Callable[[], T]) -> T:
    """What ``run`` gives; the shuffle files of its executions are removed as they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return run()
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, path: str) -> DataFrame:
    """The table written to a folder and read from there."""
    tidy(df.sparkSession, lambda: df.write.parquet(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)
