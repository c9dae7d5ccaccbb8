"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where a session on one machine names none, a temporary folder stands in, removed at the end."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            at = tempfile.mkdtemp(prefix="pointmill-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """path, which the driver removes when it ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of frames that are made within as soon as an action on them is over.

    Else they stay until the driver collects its garbage, so that operators of many short jobs fill the disk.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settled(df: DataFrame) -> DataFrame:
    """The rows of df computed once, with the lineage cut by a reliable checkpoint; what was shuffled for them is deleted."""
    shared_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`settled` but as a Parquet table in the shared folder (columnar, compressed)."""
    spark = df.sparkSession
    path = removed_at_exit(spark, f"{shared_dir(spark)}/pm-{name}-{uuid.uuid4().hex}")
    with shuffles_freed(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffled_by_rows(spark: SparkSession, rows: int, per_task: int) -> Iterator[None]:
    """What runs within shuffles into one part for ``per_task`` of so many rows, but one for each core at least.

    Adaptive execution would join parts again by their bytes, of which rows that repeat each other have few.
    """
    own = {"spark.sql.shuffle.partitions": str(max(spark.sparkContext.defaultParallelism, math.ceil(rows / per_task))), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
