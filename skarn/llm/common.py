"""What the corpus operators share: the shared folder, skew-proof joins and ranks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A group is hot when it has more than one part in HOT_PARTS of all rows, so at most HOT_PARTS groups are.
HOT_PARTS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("skarn.shared.dir", None)
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="skarn-")
    spark.conf.set("skarn.shared.dir", at)
    sc.setCheckpointDir(at)
    return at


_made: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    if _made:
        _made[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_stored(*dfs: DataFrame) -> None:
    """Delete tables that stored() wrote and that no later query reads."""
    for df in dfs:
        _delete(df.sparkSession, {os.path.dirname(f) for f in df.inputFiles()})


class Leftovers:
    """Tables that a chain of steps stored on the way. Each step's output is written before the next step starts, so its own tables can go then.

    A table stays while the next input reads it, and while it belongs to a step over that same input (whose output may still be pending).
    All stay where the next input names no files, as a cached one does.
    """

    def __init__(self) -> None:
        self.tables: list[tuple[str, frozenset[str]]] = []

    def step(self, make: Callable[[], DataFrame], docs: DataFrame) -> DataFrame:
        given = frozenset(os.path.dirname(f) for f in docs.inputFiles())
        read = {os.path.basename(d) for d in given}
        gone = [t for t in self.tables if given and t[1] != given and os.path.basename(t[0]) not in read]
        _delete(docs.sparkSession, [p for p, _ in gone])
        self.tables = [t for t in self.tables if t not in gone]
        _made.append([])
        try:
            return make()
        finally:
            self.tables += [(p, given) for p in _made.pop()]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_hash(text: Column) -> Column:
    """32 bits that tell unlike texts under one id apart. Null is empty."""
    return F.hash(F.coalesce(text, F.lit("")))


def attach(rows: DataFrame, groups: DataFrame, key: str, row_id: Column, size: str, total: int) -> DataFrame:
    """rows LEFT JOIN groups on a string key, safe when one key has a third of all rows.

    Groups of more than total / HOT_PARTS rows (so at most HOT_PARTS of them, whatever the data) are
    broadcast. Their rows take an unmatchable key of their own through the shuffled join with the rest.
    """
    cols = [c for c in groups.columns if c != key]
    limit = max(1, total // HOT_PARTS)
    hot = groups.filter(F.col(size) > limit).select(F.col(key), F.struct(*cols).alias("_hot"))
    cold = groups.filter(F.col(size) <= limit).select(F.col(key).alias("_key"), F.struct(*cols).alias("_cold"))
    out = rows.join(F.broadcast(hot), key, "left")
    own = F.concat(F.lit("!"), F.coalesce(row_id.cast("string"), F.lit("")), F.lit("!"), F.expr("cast(monotonically_increasing_id() as string)"))
    out = out.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(own))
    out = out.join(cold, "_key", "left")
    got = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *[got[c].alias(c) for c in cols])


def spread_rank(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds a gapless rank from 0 within keys, with no task that holds a whole key.

    Rows of a key are split by a hash of their order columns; each part is ranked on its own
    and shifted by the number of rows in the parts before it.
    """
    n = 2 * partitions(df.sparkSession)
    df = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = df.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    out = df.withColumn("_local", local).join(counts, [*keys, "_part"])
    return out.withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_part", "_local", "_before")
