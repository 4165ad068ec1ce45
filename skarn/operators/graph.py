"""Proximity graphs: built and searched part by part, with the parts' best results merged.

A part is a bounded number of vectors, so that graphs grow with the number of tasks and not in size. Graphs are built from
blocks of all distances of a part, and queries walk side by side: every step is a few array operations for a block of queries. Exact
search (skarn.operators.knn) is the default of the engine; graphs trade recall for fewer distances.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions.distance import TINY, DistanceMetric, block
from skarn.operators.knn import Nearest, matrix

#: Vectors a graph. At 2,000 a walk of width 64 finds 0.9 of the neighbours of vectors without clusters; the walks of larger graphs need more width.
PART = 2_000
#: A walk meets nearly all nodes of a graph of up to so many times its width, at many times the cost of a product with all of them.
SMALL = 4
#: Queries that walk side by side.
ABREAST = 256


def _distances(metric: DistanceMetric, dots: np.ndarray, qq: np.ndarray, vv: np.ndarray) -> np.ndarray:
    """Distances from inner products and squared norms."""
    if metric is DistanceMetric.INNER_PRODUCT:
        return 1.0 - dots
    if metric is DistanceMetric.L2:
        return np.maximum(qq + vv - 2.0 * dots, 0.0)
    norms = np.sqrt(qq * vv)
    return np.where(norms < TINY, 1.0, 1.0 - np.clip(dots / np.maximum(norms, TINY), -1.0, 1.0))


def nearest(x: np.ndarray, c: int, metric: DistanceMetric) -> tuple[np.ndarray, np.ndarray]:
    """The c nearest other nodes of each node and their distances, nearest first."""
    n = len(x)
    c = min(c, n - 1)
    ids, ds = np.zeros((n, max(0, c)), np.int64), np.zeros((n, max(0, c)))
    if c <= 0:
        return ids, ds
    sq, step = np.einsum("ij,ij->i", x, x), max(1, (2 << 20) // n)
    for at in range(0, n, step):
        rows = np.arange(at, min(n, at + step))
        d = _distances(metric, x[rows] @ x.T, sq[rows, None], sq[None, :])
        d[np.arange(len(rows)), rows] = np.inf
        i = np.argpartition(d, c - 1, axis=1)[:, :c]
        d = np.take_along_axis(d, i, 1)
        order = np.lexsort((i, d), axis=1)
        ids[rows], ds[rows] = np.take_along_axis(i, order, 1), np.take_along_axis(d, order, 1)
    return ids, ds


def prune(x: np.ndarray, ids: np.ndarray, ds: np.ndarray, degree: int, metric: DistanceMetric, alpha: float = 1.0) -> np.ndarray:
    """Of each row's candidates, nearest first, those nearer to the node than alpha times their distance to any chosen before, then the nearest others.

    Missing candidates have an infinite distance, missing links the number len(x).
    """
    n, c = ids.shape
    out = np.full((n, degree), len(x), np.int64)
    step = max(1, (1 << 20) // max(1, c * max(c, x.shape[1])))
    for at in range(0, n, step):
        i, d = ids[at : at + step], ds[at : at + step]
        there = np.isfinite(d)
        v = x[np.where(there, i, 0)]
        dots = v @ v.transpose(0, 2, 1)
        sq = np.einsum("bii->bi", dots)
        between = alpha * _distances(metric, dots, sq[:, :, None], sq[:, None, :])
        free, kept, n_kept = there.copy(), np.zeros_like(there), np.zeros(len(i), np.int64)
        for j in range(c):
            take = free[:, j] & (n_kept < degree)
            kept[:, j] = take
            n_kept += take
            free &= ~(take[:, None] & (between[:, j] <= d))
        order = np.argsort(np.where(kept, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :degree]
        out[at : at + step, : order.shape[1]] = np.where(np.take_along_axis(there, order, 1), np.take_along_axis(i, order, 1), len(x))
    return out


def both_ways(x: np.ndarray, links: np.ndarray, most: int, metric: DistanceMetric, alpha: float = 1.0) -> np.ndarray:
    """Links and their reverses, at most `most` a node: fuller nodes are pruned."""
    n = len(x)
    src, at = np.nonzero(links < n)
    dst = links[src, at]
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    src, dst = np.divmod(np.unique(src * n + dst), n)
    sq, d = np.einsum("ij,ij->i", x, x), np.empty(len(src))
    for s in range(0, len(src), 1 << 16):
        a, b = src[s : s + (1 << 16)], dst[s : s + (1 << 16)]
        d[s : s + (1 << 16)] = _distances(metric, np.einsum("ij,ij->i", x[a], x[b]), sq[a], sq[b])
    order = np.lexsort((dst, d, src))
    src, dst, d = src[order], dst[order], d[order]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    near = place < 3 * most
    ids, ds = np.zeros((n, 3 * most), np.int64), np.full((n, 3 * most), np.inf)
    ids[src[near], place[near]], ds[src[near], place[near]] = dst[near], d[near]
    out = np.where(np.isfinite(ds[:, :most]), ids[:, :most], n)
    full = np.isfinite(ds[:, most:]).any(axis=1)
    out[full] = prune(x, ids[full], ds[full], most, metric, alpha)
    return out


def joined(x: np.ndarray, links: np.ndarray, start: int, metric: DistanceMetric) -> np.ndarray:
    """Links by which every node is reached from `start`: one that isn't gets a link from the nearest reached node with room."""
    n = len(x)
    reached = np.zeros(n + 1, bool)
    reached[[start, n]] = True
    front = np.array([start])
    while True:
        while len(front):
            front = np.unique(links[front])
            front = front[~reached[front]]
            reached[front] = True
        left = np.flatnonzero(~reached)
        if not len(left):
            return links
        if not (links[reached[:n]] == n).any():
            links = np.hstack([links, np.full((n, 1), n)])
        rooms = np.flatnonzero(reached[:n] & (links == n).any(axis=1))
        near = int(rooms[block(metric, x[left[:1]], x[rooms])[0].argmin()])
        links[near, int((links[near] == n).argmax())] = left[0]
        reached[left[0]] = True
        front = left[:1]


def linked(x: np.ndarray, degree: int, most: int, width: int, metric: DistanceMetric, alpha: float, start: int) -> np.ndarray:
    """A graph's links, a row a node: `degree` of the `width` nearest nodes, and reverses up to `most`. len(x) stands for none."""
    ids, ds = nearest(x, max(degree, width), metric)
    return joined(x, both_ways(x, prune(x, ids, ds, degree, metric, alpha), most, metric, alpha), start, metric)


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, starts: np.ndarray, width: int, metric: DistanceMetric, work: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and distances, width of each at most, that best-first walks of all queries (rows of q) find from their starts (a row a query), nearest first.

    Missing ones are len(x) and infinite. `work` (2 x queries) gets the numbers of distances and of nodes visited added.
    """
    n, m = len(x), len(q)
    x = np.vstack([np.asarray(x, np.float64), np.zeros((1, x.shape[1]))])
    sq, qq = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
    ids, ds = np.full((m, width), n), np.full((m, width), np.inf)
    done, seen = np.ones((m, width), bool), np.zeros((m, n + 1), bool)
    seen[:, n] = True
    on, new = np.arange(m), starts
    while True:
        fresh = ~seen[on[:, None], new]
        seen[on[:, None], new] = True
        if work is not None:
            work[0, on] += fresh.sum(axis=1)
            work[1, on] += fresh.any(axis=1)
        d = _distances(metric, (x[new] @ q[on][:, :, None])[:, :, 0], qq[on, None], sq[new])
        d[~fresh] = np.inf
        d, i = np.concatenate([ds[on], d], axis=1), np.concatenate([ids[on], new], axis=1)
        f = np.concatenate([done[on], np.zeros(new.shape, bool)], axis=1)
        if d.shape[1] > width:
            best = np.argpartition(d, width - 1, axis=1)[:, :width]
            d, i, f = (np.take_along_axis(a, best, 1) for a in (d, i, f))
        ds[on], ids[on] = d, i
        ahead = np.where(f, np.inf, d)
        at = ahead.argmin(axis=1)
        rows = np.arange(len(on))
        more = np.isfinite(ahead[rows, at])
        f[rows, at] = True
        done[on] = f
        if not more.any():
            break
        new = links[i[rows, at][more]]
        on = on[more]
    ids[~np.isfinite(ds)] = n
    order = np.lexsort((ids, np.round(ds, 12)), axis=1)
    return np.take_along_axis(ids, order, 1), np.round(np.take_along_axis(ds, order, 1), 12) + 0.0


class _Graph:
    """What graphs share: x (a row a vector) and metric."""

    def small(self, k: int, width: int, label: int | None = None) -> np.ndarray | None:
        """The nodes (with a label: those that have it), where they are so few that all are ranked and none is walked to."""
        return None

    def _one(self, found: tuple[np.ndarray, np.ndarray]) -> list[tuple[float, int]]:
        return [(float(d), int(i)) for i, d in zip(found[0][0], found[1][0]) if math.isfinite(d)]

    def search(self, q: np.ndarray, k: int, *args, **more) -> list[tuple[float, int]]:
        """Distance and node of the k nearest that the walk finds."""
        return self._one(self.search_many(np.asarray(q, np.float64)[None, :], k, *args, **more))


class Hnsw(_Graph):
    """A layered graph. A node's top layer is -ln(U) / ln(M); layer 0 has up to 2 M links a node, others M."""

    def __init__(self, x: np.ndarray, m: int = 16, ef: int = 100, metric: DistanceMetric | str = DistanceMetric.L2, seed: int = 0) -> None:
        self.x, self.m, self.ef, self.metric = x, m, ef, DistanceMetric.parse(metric)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(len(x))) / math.log(max(2, m))).astype(int)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # the nodes, and their links as places among them
        entry = int(level.argmax()) if len(x) else -1
        for layer in range(int(level.max()) + 1 if len(x) else 0):
            nodes = np.flatnonzero(level >= layer)
            start = int(np.searchsorted(nodes, entry))
            self.layers.append((nodes, linked(np.asarray(x[nodes], np.float64), m, m if layer else 2 * m, ef, self.metric, 1.0, start)))
        self.entry = entry

    def search_many(self, q: np.ndarray, k: int, ef: int = 0, work: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and distances, a row a query: down the layers by the nearest node, then a walk of width ef."""
        if self.entry < 0:
            return np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        at = np.full((len(q), 1), self.entry)
        for layer in range(len(self.layers) - 1, -1, -1):
            nodes, links = self.layers[layer]
            starts = np.searchsorted(nodes, at)
            found, d = walk(self.x[nodes], links, q, starts, max(k, ef or self.ef) if layer == 0 else 1, self.metric, work)
            at = nodes[found] if layer else found
        return at[:, :k], d[:, :k]

    def stats(self) -> list[tuple[int, int, int]]:
        """Layer, nodes and links."""
        return [(i, len(nodes), int((links < len(nodes)).sum())) for i, (nodes, links) in enumerate(self.layers)]


class Vamana(_Graph):
    """A flat graph, pruned with alpha, and one such graph for the nodes of each tag: a search by tag walks over these, so it meets no other nodes."""

    def __init__(self, x: np.ndarray, degree: int = 64, width: int = 100, alpha: float = 1.2, tags: list[list[int]] | None = None, metric: DistanceMetric | str = DistanceMetric.L2) -> None:
        self.x, self.degree, self.metric = x, degree, DistanceMetric.parse(metric)
        of: dict[int, list[int]] = {}
        for i, own in enumerate(tags or []):
            for t in dict.fromkeys(own):
                of.setdefault(t, []).append(i)
        self.tags = {t: np.array(nodes) for t, nodes in of.items()}
        self.graphs = {t: self._link(nodes, width, alpha) for t, nodes in [(None, np.arange(len(x))), *self.tags.items()] if len(nodes)}

    def _link(self, nodes: np.ndarray, width: int, alpha: float) -> tuple[int, np.ndarray]:
        """The medoid of nodes, and their links as places among them."""
        x = np.asarray(self.x[nodes], np.float64)
        start = int(block("l2", x.mean(axis=0)[None, :], x)[0].argmin())
        return start, linked(x, self.degree, self.degree, width, self.metric, alpha, start)

    def small(self, k: int, width: int, label: int | None = None) -> np.ndarray | None:
        nodes = np.arange(len(self.x)) if label is None else self.tags.get(label, np.zeros(0, np.int64))
        return nodes if len(nodes) <= SMALL * max(k, width) else None

    def search_many(self, q: np.ndarray, k: int, width: int = 100, label: int | None = None, work: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and distances, a row a query. With a label, only nodes that have the tag."""
        if label not in self.graphs:
            return np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        start, links = self.graphs[label]
        nodes = np.arange(len(self.x)) if label is None else self.tags[label]
        found, d = walk(self.x[nodes], links, q, np.full((len(q), 1), start), max(k, width), self.metric, work)
        return np.append(nodes, len(self.x))[found[:, :k]], d[:, :k]


def build(df: DataFrame, kind: str = "hnsw", *, id_col: str = "vec_id", vec_col: str = "embedding", tags_col: str | None = None, part: int = PART, **params) -> DataFrame:
    """part, ids and graph (pickled): one graph for each part of about `part` vectors."""
    rows = df.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), (F.col(tags_col) if tags_col else F.lit(None)).cast("array<long>").alias("tags"))
    parts = max(1, -(-rows.count() // part))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))

    def one(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        x = matrix(table.column("v").combine_chunks())
        if kind == "hnsw":
            graph = Hnsw(x, **params)
        else:
            graph = Vamana(x, tags=[t or [] for t in table.column("tags").to_pylist()], **params)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "ids": pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())), "graph": pa.array([pickle.dumps(graph)], pa.binary())})

    return rows.groupBy("part").applyInArrow(one, "part int, ids array<long>, graph binary")


def search(graphs: DataFrame, queries: list[tuple[int, list[float]]], k: int, ef: int = 100, label: int | None = None, stats: bool = False) -> DataFrame:
    """qid, rank, id, distance: the parts' best k of each query, merged. With stats, also dist_comps and hops: what the query took in all parts.

    Flat graphs that are small (with a label: its own graphs) are ranked whole, which counts as one hop.
    """
    vectors = np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
    held = graphs.sparkSession.sparkContext.broadcast((np.array([q for q, _ in queries], np.int64), vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vectors = held.value
        best_d, best_i, work = np.full((len(qids), k), np.inf), np.full((len(qids), k), -1, np.int64), np.zeros((2, len(qids)), np.int64)
        whole, met, parts = None, 0, 0
        for batch in batches:
            for ids, blob in zip(batch.column(0), batch.column(1)):
                ids, graph = np.append(ids.values.to_numpy(), -1), pickle.loads(blob.as_buffer())
                small = graph.small(k, ef, label)
                if small is not None:
                    whole = whole or Nearest(vectors, k, graph.metric)
                    whole.add(ids[small], graph.x[small])
                    met, parts = met + len(small), parts + (len(small) > 0)
                    continue
                for at in range(0, len(qids), ABREAST):
                    mine = slice(at, at + ABREAST)
                    args = (vectors[mine], k, ef) if label is None else (vectors[mine], k, ef, label)
                    nodes, d = graph.search_many(*args, work=work[:, mine])
                    d, i = np.hstack([best_d[mine], d]), np.hstack([best_i[mine], ids[nodes]])
                    order = np.lexsort((i, d), axis=1)[:, :k]
                    best_d[mine], best_i[mine] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        found = [(best_d, best_i, work)]
        if whole:
            found.append((whole.d, whole.i, np.full(work.shape, [[met], [parts]])))
        for d, i, took in found:  # a task's best k of each query
            row, col = np.nonzero(np.isfinite(d))
            cols = [qids[row], i[row, col], d[row, col], *(np.where(col == 0, w[row], 0) for w in took)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["qid", "id", "distance", "dist_comps", "hops"])

    found = graphs.select("ids", "graph").mapInArrow(run, "qid long, id long, distance double, dist_comps long, hops long")
    by, all_of = Window.partitionBy("qid").orderBy("distance", "id"), Window.partitionBy("qid")
    if stats:
        found = found.withColumns({c: F.sum(c).over(all_of) for c in ("dist_comps", "hops")})
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("qid", "rank", "id", "distance", *(["dist_comps", "hops"] if stats else []))


def layer_stats(graphs: DataFrame) -> DataFrame:
    """layer, nodes, links and avg_neighbors of layered graphs, over all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                cols = list(zip(*pickle.loads(blob).stats())) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["layer", "nodes", "links"])

    rows = graphs.select("graph").mapInArrow(run, "layer long, nodes long, links long")
    return rows.groupBy("layer").agg(F.sum("nodes").alias("nodes"), F.sum("links").alias("links"), (F.sum("links") / F.sum("nodes")).alias("avg_neighbors"))
