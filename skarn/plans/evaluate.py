"""Evaluation: recall against ground truth, and latency percentiles."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators.filters import where
from skarn.operators.knn import knn_join


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """qid and recall: the part of the first k true neighbours (all, where there are fewer) that was found."""
    t = truth.filter(F.col("rank") <= k).select("qid", "id")
    f = found.filter((F.col("rank") <= k) & (F.col("id") >= 0)).select("qid", "id").distinct().withColumn("_hit", F.lit(1))
    return t.join(f, ["qid", "id"], "left").groupBy("qid").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))


def mean_recall(found: DataFrame, truth: DataFrame, k: int) -> float:
    return recall(found, truth, k).agg(F.avg("recall")).first()[0]


def filtered_truth(queries: DataFrame, df: DataFrame, filter: str | dict, k: int, metric: str = "l2", **cols: str) -> DataFrame:
    """The exact neighbours among the rows that match a filter."""
    return knn_join(queries, where(df, filter), k, metric, **cols)


def latency(run: Callable[[], object], times: int) -> dict[str, float]:
    """Calls a second, and percentiles of the milliseconds a call takes."""
    ms = []
    for _ in range(times):
        t = time.perf_counter()
        run()
        ms.append((time.perf_counter() - t) * 1000)
    return {"qps": 1000 * times / sum(ms), **{f"p{p}_ms": float(np.percentile(ms, p)) for p in (50, 95, 99)}}
