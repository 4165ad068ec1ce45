"""Ordered lookups on metadata: point, range, and prefixes of composite keys, as predicates that reach the scan."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_FIELDS = 3


def _all(parts: list[Column]) -> Column:
    return functools.reduce(operator.and_, parts)


class OrderedIndex:
    """A table laid out by 1 to 3 fields. Lookups return rows in key order, then by id."""

    def __init__(self, df: DataFrame, fields: list[str], id_col: str = "doc_id", unique: bool = False) -> None:
        if not 1 <= len(fields) <= MAX_FIELDS:
            raise ValueError(f"an index has 1 to {MAX_FIELDS} fields")
        missing = [f for f in fields if f not in df.columns]
        if missing:
            raise ValueError(f"not in schema: {', '.join(missing)}")
        self.df, self.fields, self.id_col, self.unique = df, list(fields), id_col, unique

    def write(self, path: str) -> None:
        """Files sorted by key over disjoint ranges: row-group statistics then prune lookups."""
        if self.unique and self.duplicates().limit(1).count():
            raise ValueError("duplicate keys in a unique index")
        self.df.repartitionByRange(*self.fields).sortWithinPartitions(*self.fields, self.id_col).write.mode("overwrite").parquet(path)

    def duplicates(self) -> DataFrame:
        keys = self.df.filter(_all([F.col(f).isNotNull() for f in self.fields]))
        return keys.groupBy(*self.fields).count().filter("count > 1")

    def _sorted(self, cond: Column, descending: bool = False) -> DataFrame:
        by = [F.desc(f) if descending else F.asc(f) for f in [*self.fields, self.id_col]]
        return self.df.filter(cond).orderBy(*by)

    def lookup(self, *key: object) -> DataFrame:
        if len(key) != len(self.fields):
            raise ValueError(f"a lookup needs all {len(self.fields)} fields")
        return self._sorted(_all([F.col(f) == F.lit(v) for f, v in zip(self.fields, key)]))

    def prefix_lookup(self, *prefix: object) -> DataFrame:
        if not 1 <= len(prefix) <= len(self.fields):
            raise ValueError("a prefix has between 1 and all of the fields")
        return self._sorted(_all([F.col(f) == F.lit(v) for f, v in zip(self.fields, prefix)]))

    def range_scan(self, low: object = None, high: object = None, low_inclusive: bool = True, high_inclusive: bool = True, descending: bool = False) -> DataFrame:
        return self._sorted(self._range(self.fields[0], low, high, low_inclusive, high_inclusive), descending)

    def prefix_range_scan(self, prefix: list, low: object = None, high: object = None, low_inclusive: bool = True, high_inclusive: bool = True) -> DataFrame:
        """Equality on the prefix and a range on the field after it."""
        if not 1 <= len(prefix) < len(self.fields):
            raise ValueError("a prefix range needs a field after the prefix")
        parts = [F.col(f) == F.lit(v) for f, v in zip(self.fields, prefix)]
        return self._sorted(_all([*parts, self._range(self.fields[len(prefix)], low, high, low_inclusive, high_inclusive)]))

    @staticmethod
    def _range(name: str, low: object, high: object, low_inclusive: bool, high_inclusive: bool) -> Column:
        c, parts = F.col(name), [F.col(name).isNotNull()]
        if low is not None:
            parts.append(c >= F.lit(low) if low_inclusive else c > F.lit(low))
        if high is not None:
            parts.append(c <= F.lit(high) if high_inclusive else c < F.lit(high))
        return _all(parts)

    def less_than(self, value: object, inclusive: bool = False) -> DataFrame:
        return self.range_scan(high=value, high_inclusive=inclusive)

    def greater_than(self, value: object, inclusive: bool = False) -> DataFrame:
        return self.range_scan(low=value, low_inclusive=inclusive)

    def contains(self, *key: object) -> bool:
        return self.lookup(*key).limit(1).count() > 0

    def entry_count(self) -> int:
        return self.df.filter(_all([F.col(f).isNotNull() for f in self.fields])).count()

    def scan(self, descending: bool = False) -> DataFrame:
        return self._sorted(F.lit(True), descending)

    def first(self, *prefix: object) -> DataFrame:
        return self.prefix_lookup(*prefix).limit(1) if prefix else self.scan().limit(1)

    def last(self, *prefix: object) -> DataFrame:
        by = [F.desc(f) for f in [*self.fields, self.id_col]]
        cond = _all([F.col(f) == F.lit(v) for f, v in zip(self.fields, prefix)]) if prefix else F.lit(True)
        return self.df.filter(cond).orderBy(*by).limit(1)


def id_union(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return a.select(id_col).union(b.select(id_col)).distinct()


def id_intersection(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return a.select(id_col).intersect(b.select(id_col))


def id_difference(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return a.select(id_col).distinct().join(b.select(id_col), id_col, "left_anti")


def bitmap(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """bucket and bits: the ids as bitmaps of 32,768 each, so sets combine bucket by bucket."""
    rows = ids.select(F.expr(f"bitmap_bucket_number({id_col})").alias("bucket"), F.expr(f"bitmap_bit_position({id_col})").alias("bit"))
    return rows.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))


def bitmap_count(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.agg(F.coalesce(F.sum(F.expr("bitmap_count(bits)")), F.lit(0)).alias("n"))


def latest(df: DataFrame, group: str, order: str, id_col: str) -> DataFrame:
    """The last row of each group by an order, ties to the largest id."""
    by = Window.partitionBy(group).orderBy(F.desc(order), F.desc(id_col))
    return df.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")
