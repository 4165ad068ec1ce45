"""Exact nearest neighbours: of one query, of many, filtered, and within a distance.

Order is by distance, then by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions.distance import TINY, DistanceMetric, distance
from skarn.operators.filters import Condition, where
from skarn.plans.layout import scratch_folder

#: Queries that go to all executors at once: at most so many bytes of vectors.
QUERY_BYTES = 32 << 20


def knn(df: DataFrame, query: list[float], k: int, metric: DistanceMetric | str = DistanceMetric.L2, *, id_col: str = "vec_id", vec_col: str = "embedding", filter: str | dict | Condition | None = None, json_column: str | None = None, strict: bool = False) -> DataFrame:
    """The k rows nearest to one query, with all columns, `distance` and `rank` from 1. The filter comes first, so the result is exact."""
    rows = where(df, filter, json_column, strict).withColumn("distance", distance(metric, F.col(vec_col), [float(x) for x in query]))
    top = rows.orderBy("distance", id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))


def within(df: DataFrame, query: list[float], most: float, metric: DistanceMetric | str = DistanceMetric.COSINE, *, vec_col: str = "embedding") -> DataFrame:
    """The rows at a distance of at most `most`."""
    return df.withColumn("distance", distance(metric, F.col(vec_col), [float(x) for x in query])).filter(F.col("distance") <= most)


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as a matrix. All lists must have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) == 0:
        return np.zeros((0, dim or 0))
    if len(flat) % len(column) or (dim and len(flat) != len(column) * dim):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def _merged(best_d: np.ndarray, best_i: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by distance, then id, of those so far and of new distances (a column for each of ids)."""
    had = best_d.shape[1]
    d = np.concatenate([best_d, d], axis=1)
    if d.shape[1] > k:
        at = np.argpartition(d, k - 1, axis=1)[:, :k]
        most = int((d <= np.take_along_axis(d, at, 1).max(axis=1)[:, None]).sum(axis=1).max())
        if most > k:  # all that tie with the k-th stay until ids decide
            at = np.argpartition(d, most - 1, axis=1)[:, :most]
    else:
        at = np.broadcast_to(np.arange(d.shape[1]), d.shape)
    d, i = np.take_along_axis(d, at, 1), ids[np.maximum(at - had, 0)]
    if had:
        i = np.where(at < had, np.take_along_axis(best_i, np.minimum(at, had - 1), 1), i)
    order = np.lexsort((i, d), axis=1)[:, :k]
    return np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)


class Nearest:
    """The k best rows of each query (d and i, nearest first; LAST in i where there are fewer), of all rows that were added.

    A product in single precision leaves out the rows that are farther than a query's k-th best by more than its error can
    be; the exact distances of the others decide. Memory is bounded by the queries and a tile.
    """

    LAST = np.iinfo(np.int64).max
    #: Queries and rows of a tile.
    TILE = 1024, 2048

    def __init__(self, queries: np.ndarray, k: int, metric: DistanceMetric | str = DistanceMetric.L2) -> None:
        self.q, self.k, self.metric = np.asarray(queries, np.float64), k, DistanceMetric.parse(metric)
        self.d, self.i = np.full((len(self.q), k), np.nan), np.full((len(self.q), k), self.LAST)
        finite = self.q[np.isfinite(self.q).all(axis=1)]
        self.centre = finite.mean(axis=0) if self.metric is DistanceMetric.L2 and len(finite) else np.zeros(self.q.shape[1])
        self.screen, self.qq = self._screen(self.q)
        self.screen = np.hstack([self.screen, np.ones((len(self.q), 1), np.float32)])

    def _screen(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors as the screening product takes them, and their squared norms."""
        with np.errstate(all="ignore"):
            x = x - self.centre
            if self.metric is DistanceMetric.COSINE:
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                x = np.where(norm * norm < TINY, np.nan, x / norm)  # a product that isn't a number leaves no row out
            return x.astype(np.float32), np.einsum("ij,ij->i", x, x)

    def add(self, ids: np.ndarray, rows: np.ndarray, own: np.ndarray | None = None) -> None:
        """Ids and vectors (a row each), which all queries meet, or those at the places `own`."""
        own = np.arange(len(self.q)) if own is None else own
        at, width = 0, 4 * self.k if np.isnan(self.d[own, -1:]).any() else self.TILE[1]
        while at < len(rows) and len(own):  # first few rows, which give the next ones a bound
            x, i = np.asarray(rows[at : at + width], np.float64), ids[at : at + width]
            screen, vv = self._screen(x)
            half = vv[:, None] / 2 if self.metric is DistanceMetric.L2 else np.zeros((len(x), 1))
            with np.errstate(all="ignore"):
                screen = np.hstack([screen, -half.astype(np.float32)])
            most = float(vv[np.isfinite(vv)].max(initial=0.0))
            for a in range(0, len(own), self.TILE[0]):
                self._tile(own[a : a + self.TILE[0]], i, x, screen, most)
            at, width = at + width, min(2 * width, self.TILE[1])

    def _tile(self, own: np.ndarray, ids: np.ndarray, x: np.ndarray, screen: np.ndarray, most: float) -> None:
        with np.errstate(all="ignore"):
            near, qq = self.screen[own] @ screen.T, self.qq[own]
            slack = (x.shape[1] + 8) * 2.0**-22 * (np.sqrt(qq * most) + most / 2)
            slack[(qq > 1e30) | (most > 1e30)] = np.inf
            bound = self.d[own, -1]
            least = (qq - bound) / 2 if self.metric is DistanceMetric.L2 else 1.0 - bound
            least = np.where(np.isnan(bound), -np.inf, least - slack - 1e-6 * np.abs(least) - 1e-11)
            if len(x) >= self.k and np.isnan(bound).any() and np.isfinite(near).all():  # the k-th best of these rows bounds too
                kth = np.partition(near, len(x) - self.k, axis=1)[:, len(x) - self.k].astype(np.float64)
                least = np.maximum(least, kth - 2 * slack - 1e-6 * np.abs(kth) - 1e-11)
            place = np.flatnonzero(~(near < least.astype(np.float32)[:, None]))
        for a in range(0, len(place), 1 << 15):
            self._pairs(own, *np.divmod(place[a : a + (1 << 15)], len(x)), ids, x)

    def _pairs(self, own: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Merges pairs of queries (places in own, ascending) and rows."""
        q, v = self.q[own[a]], x[b]
        with np.errstate(all="ignore"):
            if self.metric is DistanceMetric.L2:
                q -= v
                d = np.einsum("ij,ij->i", q, q)
            else:
                d = np.einsum("ij,ij->i", q, v)
                if self.metric is DistanceMetric.COSINE:
                    norms = np.sqrt(np.einsum("ij,ij->i", q, q) * np.einsum("ij,ij->i", v, v))
                    d = np.where(norms < TINY, 0.0, np.clip(d / norms, -1.0, 1.0))
                d = 1.0 - d
            d = np.round(d, 12) + 0.0
            last_d, last_i = self.d[own[a], -1], self.i[own[a], -1]
            new = ~(d > last_d) & ~((d == last_d) & (ids[b] > last_i))
        a, b, d = a[new], b[new], d[new]
        had = np.unique(a)
        a = np.concatenate([np.repeat(had, self.k), a])
        d, i = np.concatenate([self.d[own[had]].ravel(), d]), np.concatenate([self.i[own[had]].ravel(), ids[b]])
        order = np.lexsort((i, d, a))
        a, d, i = a[order], d[order], i[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        top = rank < self.k
        self.d[own[a[top]], rank[top]], self.i[own[a[top]], rank[top]] = d[top], i[top]

    def batch(self, qids: np.ndarray) -> pa.RecordBatch:
        """qid, id and distance of all that were found."""
        row, col = np.nonzero(self.i != self.LAST)
        return pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(self.i[row, col]), pa.array(self.d[row, col])], names=["qid", "id", "distance"])


def _nearest(queries: Broadcast, k: int, metric: DistanceMetric):
    """A task's k best rows for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vectors = queries.value
        best = None
        for batch in batches:
            best = best or Nearest(vectors, k, metric)
            best.add(batch.column(0).to_numpy(), matrix(batch.column(1), vectors.shape[1]))
        if best:
            yield best.batch(qids)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("qid", "rank", "id", "distance")


def knn_join(queries: DataFrame, df: DataFrame, k: int, metric: DistanceMetric | str = DistanceMetric.L2, *, qid_col: str = "vec_id", qvec_col: str = "embedding", id_col: str = "vec_id", vec_col: str = "embedding", padded: bool = False) -> DataFrame:
    """qid, rank, id, distance: the k nearest rows of df for every query.

    Queries go to the executors in blocks of at most QUERY_BYTES; each task reads its
    rows once a block, makes a matrix product of both, and passes k rows a query on. Of several blocks one is held at a
    time: its results are written below the scratch folder before the next is fetched. With
    padded, missing neighbours have id -1 and an infinite distance.
    """
    metric = DistanceMetric.parse(metric)
    spark = df.sparkSession
    q = queries.select(F.col(qid_col).cast("long").alias("qid"), F.col(qvec_col).alias("v")).filter("v is not null")
    asked, dim = q.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    result = None
    if asked:
        fit = max(1, QUERY_BYTES // (8 * max(1, dim)))
        blocks = -(-asked // fit)
        at = f"{scratch_folder(spark)}/neighbours" if blocks > 1 else ""
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter("v is not null")
        for b in range(blocks):
            mine = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)).toArrow()
            held = spark.sparkContext.broadcast((mine.column(0).to_numpy(), matrix(mine.column(1).combine_chunks())))
            result = rows.mapInArrow(_nearest(held, k, metric), "qid long, id long, distance double")
            if blocks > 1:
                result = _best(result, k).drop("rank")
                result.write.mode("append").parquet(at)
                held.destroy()
        if blocks > 1:
            result = spark.read.schema("qid long, id long, distance double").parquet(at)
    if result is None:
        result = spark.createDataFrame([], "qid long, id long, distance double")
    top = _best(result, k)
    if not padded:
        return top
    places = q.select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    got = places.join(top, ["qid", "rank"], "left")
    return got.select("qid", "rank", F.coalesce("id", F.lit(-1)).cast("long").alias("id"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def with_tag(df: DataFrame, label: int, tags_col: str = "tags") -> DataFrame:
    """The rows that have a tag, among however many."""
    return df.filter(F.array_contains(tags_col, F.lit(label)))


def without(df: DataFrame, tombstones: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The rows that no tombstone names."""
    return df.join(tombstones.select(id_col), id_col, "left_anti")


def centroids(df: DataFrame, group: Column | str, vec_col: str = "embedding") -> DataFrame:
    """group and centroid: the mean vector of each group."""
    g = F.col(group) if isinstance(group, str) else group
    means = df.select(g.alias("_g"), F.posexplode(vec_col).alias("_p", "_x")).groupBy("_g", "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    got = means.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_p", "_m"))).alias("_v"))
    return got.select(F.col("_g").alias("group"), F.col("_v._m").alias("centroid"))


def medoids(df: DataFrame, group: str, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """group and medoid: the id of the row nearest to its group's centroid. Groups are joined by key; ties go to the smallest id."""
    near = df.join(centroids(df, group, vec_col).withColumnRenamed("group", group), group)
    near = near.select(group, id_col, distance(DistanceMetric.L2, F.col(vec_col), F.col("centroid")).alias("_d"))
    return near.groupBy(group).agg(F.min_by(id_col, F.struct("_d", id_col)).alias("medoid"))
