"""Folders for intermediate tables, below the one that the session names: cutting lineage, and tables of a query's own."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def top(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="bibliarium-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    top(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; it goes when the process ends."""
    path = f"{top(spark)}/{what}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _drop_all() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the JVM may have gone already
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
