"""Sharding by longest-processing-time scheduling of groups that stay together."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.llm.common import attach, spread_rank, stored


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, int]]:
    """LPT over (size, number of groups of that size): rows of size, first, last, shard.

    The groups of a size are numbered from 0; first..last go to the shard. Sizes are taken from
    large to small and each group goes to the least-loaded shard, ties to the smallest shard number.
    Where a size has more groups than shards and all loads lie within one size, whole rounds are
    dealt at once: that is what the heap would do one by one.
    """
    heap = [(0, s) for s in range(shards)]
    for size, count in sorted(sizes, reverse=True):
        done = 0
        out: list[tuple[int, int, int, int]] = []
        while done < count:
            rounds = (count - done) // shards
            if rounds and max(heap)[0] - heap[0][0] <= size:
                for load, s in sorted(heap):
                    out.append((size, done, done + rounds - 1, s))
                    done += rounds
                heap = [(load + size * rounds, s) for load, s in heap]
                heapq.heapify(heap)
                continue
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            if out and out[-1][3] == s and out[-1][2] == done - 1:
                out[-1] = (size, out[-1][1], done, s)
            else:
                out.append((size, done, done, s))
            done += 1
        yield from out


def plan_table(sizes: pa.Table, shards: int) -> pa.Table:
    """The schedule of sizes (_bytes, count): for each size its shards, and the first group's number of each shard's run."""
    first, shard, ends, order = array("q"), array("i"), array("q", [0]), array("q")
    pairs = zip(sizes.column("_bytes").to_pylist(), sizes.column("count").to_pylist())
    for size, runs in groupby(schedule(pairs, shards), lambda r: r[0]):
        order.append(size)
        for _, lo, _, s in runs:
            first.append(lo)
            shard.append(s)
        ends.append(len(first))
    at = pa.array(np.array(ends), pa.int64())
    lists = [pa.LargeListArray.from_arrays(at, pa.array(np.array(x))) for x in (first, shard)]
    count = dict(zip(sizes.column("_bytes").to_pylist(), sizes.column("count").to_pylist()))
    names = pa.array([str(x) for x in order], pa.string())
    return pa.table({"_size": names, "_first": lists[0], "_shard": lists[1], "_count": pa.array([count[x] for x in order], pa.int64())})


def shard_documents(docs: DataFrame, shards: int = 24, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_sha256.

    Law `bytes`: loads are near equal, and equal texts share a shard. A document's size is the
    UTF-8 bytes of its text plus 8. A null text has size 8 and the text_crc32 of an empty one (0),
    but null texts are a group of their own. Repeated rows are documents of one group. Slots run
    from 0 in each shard, in the order of doc_id. Fewer groups than shards leave shards empty.

    The driver gets the distinct group sizes with their counts, not the groups. Distinct sizes sum
    up to at most the bytes of the corpus, so there are at most sqrt(2 x bytes) of them (14 million for 100 TB: about half a
    GB as arrays). The plan is a table with one row a size, which groups join by their size; sizes that many groups have are broadcast (attach()).
    """
    spark = docs.sparkSession
    t = F.col(text).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(t.cast("binary"), 256), F.lit("null")).alias("group_sha256"),
    )
    rows = stored(rows, "sizes")
    groups = rows.groupBy("group_sha256").agg(F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_bytes"))
    groups = stored(spread_rank(groups, ["_bytes"], ["group_sha256"], "_nth"), "groups")
    plan = plan_table(groups.groupBy("_bytes").count().toArrow(), shards)
    if not plan.num_rows:
        return spark.createDataFrame([], f"doc_id {dict(rows.dtypes)['doc_id']}, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, group_sha256 string")
    placed = attach(groups.withColumn("_size", F.col("_bytes").cast("string")), spark.createDataFrame(plan), "_size", F.col("group_sha256"), "_count", groups.count())
    run = F.size(F.filter("_first", lambda x: x <= F.col("_nth")))
    placed = placed.select("group_sha256", "_rows", F.element_at("_shard", run).cast("int").alias("shard"))
    out = attach(rows, placed, "group_sha256", F.col("doc_id"), "_rows", rows.count())
    out = spread_rank(out, ["shard"], ["doc_id", "group_sha256"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_sha256")


def write_shards(docs: DataFrame, path: str, shards: int = 24, text: str = "text", id_col: str = "doc_id") -> None:
    """Write the documents as one folder per shard, in slot order within each file.

    All columns stay, with `shard` and `slot` (`shard_of_plan`, `slot_of_plan` where the input has such names) added.
    """
    plan = shard_documents(docs, shards, text, id_col).select(F.col("doc_id").alias("_id"), "group_sha256", "shard", "slot")
    by = Window.partitionBy("_id", "group_sha256").orderBy("slot")
    plan = plan.withColumn("_nth", F.row_number().over(by))  # rows that repeat an id and its text take its slots in turn
    names = [f"_in_{i}" for i in range(len(docs.columns))]  # the input's own names can't clash with those of the join
    ident, t = (F.col(names[docs.columns.index(c)]) for c in (id_col, text))
    sha = F.coalesce(F.sha2(t.cast("string").cast("binary"), 256), F.lit("null"))
    mine = docs.toDF(*names).withColumn("_sha", sha)
    mine = mine.withColumn("_n", F.row_number().over(Window.partitionBy(ident, "_sha").orderBy(F.lit(0))))
    out = mine.join(plan, ident.eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("group_sha256")) & (F.col("_n") == F.col("_nth"))).select(*names, "shard", "slot")
    extra = [c if c not in docs.columns else f"{c}_of_plan" for c in ("shard", "slot")]
    out = out.toDF(*docs.columns, *extra)
    out.repartition(extra[0]).sortWithinPartitions(*extra).write.partitionBy(extra[0]).parquet(path)
