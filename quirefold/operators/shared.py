"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session without one takes a folder of its own; a cluster must name one."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='quirefold-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark).rstrip('/')}/quirefold-{uuid.uuid4().hex}/{name}"


def checkpoint(df: DataFrame) -> DataFrame:
    folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, by: str) -> DataFrame:
    """The rows dealt over all cores by a column, however few files or tasks they come from; a task takes its share as a stream."""
    return df.repartition(4 * max(2, df.sparkSession.sparkContext.defaultParallelism), by)
