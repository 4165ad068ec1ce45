"""The layout of inputs, and folders for scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, or a temporary one where that is unset in local mode."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        if re.match(r"\w+:", shared) and not shared.startswith("file:"):
            raise ValueError(f"not a mounted folder: {shared}")
        return f"{re.sub('^file:/*', '/', shared)}/skarn-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="skarn-")


def _bytes(df: DataFrame) -> int:
    """The size of the files that a table is read from, or the planner's estimate where there are none. No job runs."""
    plan, total = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(plan.size()):
        total += int(str(plan.apply(i).stats().sizeInBytes()))
    return total


def dealt(df: DataFrame, *keys: str, like: DataFrame, most: int = 8 << 20) -> DataFrame:
    """A table by keys in partitions of about `most` bytes of the files that `like` is read from, at least one a core. Adaptive plans don't merge them, so
    tasks that sort them need no more memory as the table grows."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-_bytes(like) // most))
    return df.repartition(min(n, 1 << 16), *keys)


def spread(df: DataFrame, least_bytes: int = 1 << 20, most_bytes: int = 1 << 30) -> DataFrame:
    """A table of few files and row groups over all cores; larger tables have splits enough and stay as they are.

    For tables as they are read: the planner's size estimate decides, and no job runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not least_bytes <= size < most_bytes or size >= cores * (32 << 20):
        return df
    return df.repartition(cores)
