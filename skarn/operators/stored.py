"""Ordered indices that take inserts, updates and removals: a log of Parquet files, the last entry of a key counting.

An entry is a key, its payload, a sequence number and whether it removes the key. Writing appends files; reading takes the
last entry of each key by one aggregation; compact() writes the live entries anew.
"""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.operators.ordered import OrderedIndex


class LogTable:
    """Rows of a schema by unique key. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: list[str]) -> None:
        self.spark, self.path, self.key = spark, path, list(key)
        self.schema = spark.createDataFrame([], schema).schema
        self.payload = [f.name for f in self.schema.fields if f.name not in self.key]
        os.makedirs(path, exist_ok=True)
        self._seq = max([int(e.split("-")[1]) for e in os.listdir(path) if e.startswith("log-")], default=0)

    def _write(self, rows: DataFrame, gone: bool) -> None:
        self._seq += 1
        entries = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], F.lit(self._seq).cast("long").alias("_seq"), F.lit(gone).alias("_gone"))
        at = os.path.join(self.path, f"new-{uuid.uuid4().hex}")
        entries.write.parquet(at)
        os.rename(at, os.path.join(self.path, f"log-{self._seq:012d}"))  # readers see whole batches only

    def _entries(self) -> DataFrame:
        logs = [os.path.join(self.path, e) for e in sorted(os.listdir(self.path)) if e.startswith("log-")]
        schema = T.StructType([*self.schema.fields, T.StructField("_seq", T.LongType()), T.StructField("_gone", T.BooleanType())])
        return self.spark.read.schema(schema).parquet(*logs) if logs else self.spark.createDataFrame([], schema)

    def live(self, cond: Column | None = None) -> DataFrame:
        """The live rows. A condition on key columns reaches the files."""
        rows = self._entries() if cond is None else self._entries().filter(cond)
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*self.payload, "_gone"), "_seq").alias("_last"))
        return last.filter("not _last._gone").select(*[F.col(f"_last.{f.name}") if f.name in self.payload else F.col(f.name) for f in self.schema.fields])

    def _frame(self, rows: list[tuple] | DataFrame) -> DataFrame:
        return rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, self.schema)

    def put(self, rows: list[tuple] | DataFrame) -> None:
        """Inserts or replaces. Of rows of one key in a batch any one stays."""
        self._write(self._frame(rows), False)

    def insert(self, rows: list[tuple] | DataFrame) -> None:
        """Raises if a key is there already, or twice in the batch."""
        new = self._frame(rows)
        there = new.select(*self.key).join(self.live().select(*self.key), self.key, "left_semi").limit(1).count()
        if there or new.groupBy(*self.key).count().filter("count > 1").limit(1).count():
            raise ValueError("a key is there already")
        self._write(new, False)

    def _missing(self, keys: DataFrame) -> int:
        return keys.select(*self.key).join(self.live().select(*self.key), self.key, "left_anti").count()

    def update(self, rows: list[tuple] | DataFrame) -> None:
        """Replaces payloads; raises if a key isn't there."""
        new = self._frame(rows)
        if self._missing(new):
            raise KeyError("a key isn't there")
        self._write(new, False)

    def update_where(self, cond: Column, **changes: Column) -> None:
        """Changes payload columns of the live rows that match."""
        self._write(self.live().filter(cond).withColumns(changes), False)

    def remove(self, keys: list[tuple] | DataFrame) -> int:
        """Removes keys; how many there were."""
        kinds = T.StructType([f for f in self.schema.fields if f.name in self.key])
        given = keys if isinstance(keys, DataFrame) else self.spark.createDataFrame(keys, kinds)
        gone = self.live().join(given.select(*self.key).distinct(), self.key, "left_semi").select(*self.schema.names)
        n = gone.count()
        if n:
            self._write(gone, True)
        return n

    def lookup(self, *key: object) -> DataFrame:
        cond = F.lit(True)
        for name, value in zip(self.key, key, strict=True):
            cond = cond & (F.col(name) == F.lit(value))
        return self.live(cond)

    def contains(self, *key: object) -> bool:
        return self.lookup(*key).limit(1).count() > 0

    def count(self) -> int:
        return self.live().count()

    def ordered(self, id_col: str | None = None) -> OrderedIndex:
        """Lookups, range scans and prefixes (count them for a prefix count) over the live rows, ascending or descending."""
        fields = [k for k in self.key if k != id_col][:3]
        return OrderedIndex(self.live(), fields, id_col or self.key[-1])

    def compact(self) -> None:
        old = [e for e in os.listdir(self.path) if e.startswith("log-")]
        self._write(self.live(), False)
        for e in old:
            shutil.rmtree(os.path.join(self.path, e))


class MetadataIndex(LogTable):
    """Up to three fields to document ids. A key of a non-unique index may have many documents."""

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, str], unique: bool = False) -> None:
        if not 1 <= len(fields) <= 3:
            raise ValueError("an index has 1 to 3 fields")
        schema = ", ".join([f"{n} {t}" for n, t in fields.items()] + ["doc_id long"])
        super().__init__(spark, path, schema, list(fields) if unique else [*fields, "doc_id"])
        if not unique:  # all columns are the key: a payload for the log's sake
            self.schema = T.StructType([*self.schema.fields, T.StructField("_there", T.BooleanType())])
            self.payload = ["_there"]
        self.unique = unique

    def _frame(self, rows: list[tuple] | DataFrame) -> DataFrame:
        if self.unique:
            return super()._frame(rows)
        kinds = T.StructType(self.schema.fields[:-1])
        return (rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, kinds)).withColumn("_there", F.lit(True))

    def insert_batch(self, rows: list[tuple] | DataFrame) -> None:
        self.insert(rows)

    def index(self) -> OrderedIndex:
        return OrderedIndex(self.live().drop("_there"), [f.name for f in self.schema.fields if f.name not in ("doc_id", "_there")], "doc_id", self.unique)


class DocIdIndex(LogTable):
    """doc_id to the place and length of a document."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, "doc_id long, page long, slot int, length long", ["doc_id"])

    def get_doc_length(self, doc_id: int) -> int | None:
        row = self.lookup(doc_id).select("length").first()
        return row[0] if row else None
