"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import attach, drop_stored, stored


def _mark(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges with the least neighbour m of u. A node that a large part of all edges has is no task's alone."""
    key = F.col("u").cast("string").alias("_u")
    return attach(edges.select(key, "u", "v"), least.select(key, "m", "_n"), "_u", F.col("v"), "_n", total)


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of the edges (u, v). Null ends are dropped."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v and u is not null and v is not null").distinct()
    now = stored(now, "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_n"))
        large = _with_least(both.filter("v > u"), least, 2 * mark[0]).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
        small = _with_least(large, least, 2 * mark[0])
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = stored(small.select("e.u", "e.v").filter("u > v").distinct(), "edges")
        after = _mark(new)
        drop_stored(now)
        now = new
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
