"""Vector indices of their own: HnswIndex, DiskANN and IVFPQIndex over stored vectors.

Each keeps its vectors as Parquet in its catalog folder. Single and batch searches of HnswIndex and DiskANN are
exact unless approximate=True, which builds graphs part by part; IVFPQIndex is approximate by design.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.catalog import BuildParams, IndexCatalog, IndexConfig, IndexType, SearchParams
from skarn.functions.distance import block
from skarn.operators import graph, ivfpq
from skarn.operators.knn import knn_join, with_tag, without
from skarn.session import Workspace

#: Tags of one vector. More are refused, so that none is ever lost.
MAX_TAGS = 8
DISKANN_DIMS = (16, 32, 64, 96, 128, 256, 384, 512, 768, 1024)


class _Stored:
    """Vectors (vec_id, embedding, tags) in a folder, with a registry entry that decides about recovery."""

    def __init__(self, workspace: Workspace, kind: IndexType, name: str, dim: int, max_elements: int, options: dict, skip_recovery: bool) -> None:
        self.workspace, self.catalog, self.dim, self.max_elements = workspace, IndexCatalog(workspace), dim, max_elements
        self._recovered = False
        if self.catalog.index_exists(name):
            info = self.catalog.get_index_info(name)
            same = info.type == kind.value and info.dimensions == dim and all(info.config.get(k) == v for k, v in options.items())
            if same and not skip_recovery:
                self._recovered = os.path.exists(os.path.join(self.catalog.path_of(info), "vectors"))
            else:
                self.catalog.drop_index(name)
        if not self.catalog.index_exists(name):
            self.catalog.create_index(name, kind, IndexConfig(dim, max_elements, options=options))
        self.handle = self.catalog.open_index(name)
        self._stats = {"searches": 0, "dist_comps": 0, "search_hops": 0}

    @property
    def path(self) -> str:
        return os.path.join(self.handle.path, "vectors")

    def vectors(self) -> DataFrame:
        spark = self.workspace.spark
        schema = "vec_id long, embedding array<float>, tags array<long>"
        return spark.read.schema(schema).parquet(self.path) if os.path.exists(self.path) else spark.createDataFrame([], schema)

    def get_count(self) -> int:
        return self.vectors().count()

    def get_dim(self) -> int:
        return self.dim

    def get_name(self) -> str:
        return self.handle.name

    def was_recovered(self) -> bool:
        return self._recovered

    def flush(self) -> None:
        """Nothing to do: vectors are durable as they are added."""

    def _append(self, items: np.ndarray, tags: list[list[int]] | None = None, first: int | None = None, ids: list[int] | None = None) -> list[int]:
        x = np.asarray(items, np.float32)
        if x.ndim != 2 or x.shape[1] != self.dim:
            raise ValueError(f"vectors must have {self.dim} elements")
        have = self.get_count()
        if have + len(x) > self.max_elements:
            raise ValueError(f"index is full: {have} + {len(x)} > {self.max_elements}")
        if tags and any(len(t) > MAX_TAGS for t in tags):
            raise ValueError(f"a vector has at most {MAX_TAGS} tags")
        ids = ids if ids is not None else list(range(have if first is None else first, (have if first is None else first) + len(x)))
        rows = [(int(i), v.tolist(), [int(t) for t in tags[n]] if tags else []) for n, (i, v) in enumerate(zip(ids, x))]
        if rows:
            self.workspace.spark.createDataFrame(rows, "vec_id long, embedding array<float>, tags array<long>").write.mode("append").parquet(self.path)
            self._forget_graphs()
        return ids

    def add_dataframe(self, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", tags_col: str | None = None) -> int:
        """Adds a DataFrame's vectors under its own ids, without passing the driver; how many. Lengths, tags and ids are checked in one pass."""
        tags = F.coalesce(F.col(tags_col).cast("array<long>"), F.array().cast("array<long>")) if tags_col else F.array().cast("array<long>")
        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("embedding"), tags.alias("tags"))
        bad = F.col("vec_id").isNull() | F.col("embedding").isNull() | (F.size("embedding") != self.dim) | (F.size("tags") > MAX_TAGS)
        n, wrong = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(bad.cast("int")), F.lit(0))).first()
        if wrong:
            raise ValueError(f"vectors must have an id, {self.dim} elements and at most {MAX_TAGS} tags")
        have = self.get_count()
        if have + n > self.max_elements:
            raise ValueError(f"index is full: {have} + {n} > {self.max_elements}")
        if n:
            rows.write.mode("append").parquet(self.path)
            self._forget_graphs()
        return n

    @property
    def _graph_path(self) -> str:
        return os.path.join(self.handle.path, "graphs")

    def _forget_graphs(self) -> None:
        shutil.rmtree(self._graph_path, ignore_errors=True)

    def _stored_graphs(self, build: Callable[[], DataFrame]) -> DataFrame:
        """The graphs of all parts, written once for the vectors there are."""
        if not os.path.exists(os.path.join(self._graph_path, "_SUCCESS")):
            build().write.mode("overwrite").parquet(self._graph_path)
        return self.workspace.spark.read.parquet(self._graph_path)

    def _walk(self, graphs: DataFrame, queries: np.ndarray, k: int, ef: int, label: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        pairs = [(i, v.tolist()) for i, v in enumerate(np.atleast_2d(np.asarray(queries, np.float64)))]
        self._stats["searches"] += len(pairs)
        return self._collect(graph.search(graphs, pairs, k, ef, label, stats=True), len(pairs), k)

    def _queries(self, queries: np.ndarray) -> DataFrame:
        q = np.atleast_2d(np.asarray(queries, np.float32))
        if q.shape[1] != self.dim:
            raise ValueError(f"queries must have {self.dim} elements")
        return self.workspace.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, embedding array<float>")

    def _collect(self, found: DataFrame, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Labels and distances, n x k; missing neighbours are -1 and infinity."""
        labels, distances = np.full((n, k), -1, np.int64), np.full((n, k), np.inf, np.float32)
        for r in found.collect():  # n x k rows at most, for queries that the caller holds
            labels[r.qid, r["rank"] - 1], distances[r.qid, r["rank"] - 1] = r.id, r.distance
            if r["rank"] == 1 and "hops" in found.columns:
                self._stats["dist_comps"] += r.dist_comps
                self._stats["search_hops"] += r.hops
        return labels, distances

    def _exact(self, rows: DataFrame, queries: np.ndarray, k: int, stats: bool = True) -> tuple[np.ndarray, np.ndarray]:
        n = len(np.atleast_2d(queries))
        self._stats["searches"] += n
        if stats:
            self._stats["dist_comps"] += n * rows.count()
        return self._collect(knn_join(self._queries(queries), rows, k, "l2", qid_col="qid"), n, k)

    def reset_stats(self) -> None:
        self._stats = dict.fromkeys(self._stats, 0)

    def get_stats(self) -> dict:
        return dict(self._stats)

    def get_stats_string(self) -> str:
        return ", ".join(f"{k}={v}" for k, v in self.get_stats().items())


class HnswIndex(_Stored):
    """Squared L2. Ids are given in order."""

    def __init__(self, workspace: Workspace, max_elements: int, dim: int = 128, M: int = 16, ef_construction: int = 200, skip_recovery: bool = False, name: str = "hnsw") -> None:
        super().__init__(workspace, IndexType.HNSW, name, dim, max_elements, {"M": M, "ef_construction": ef_construction}, skip_recovery)
        self.m, self.ef_construction = M, ef_construction

    def add_points(self, items: np.ndarray, num_threads: int = 0) -> list[int]:
        return self._append(items)

    add_items = add_points

    def add_points_with_ids(self, items: np.ndarray, ids: list[int]) -> list[int]:
        return self._append(items, ids=list(ids))

    def graphs(self) -> DataFrame:
        return self._stored_graphs(lambda: graph.build(self.vectors(), "hnsw", m=self.m, ef=self.ef_construction))

    def search_knn(self, query: np.ndarray, k: int, ef_search: int = 0, stats: bool = False, approximate: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Labels and distances of one query; fewer than k where the index has fewer."""
        labels, distances = self.search_knn_parallel(np.atleast_2d(query), k, ef_search, approximate=approximate)
        got = labels[0] >= 0
        return labels[0][got], distances[0][got]

    def search_knn_parallel(self, queries: np.ndarray, k: int, ef_search: int = 0, num_threads: int = 0, approximate: bool = False) -> tuple[np.ndarray, np.ndarray]:
        if not approximate:
            return self._exact(self.vectors(), queries, k)
        return self._walk(self.graphs(), queries, k, max(k, ef_search or self.ef_construction))

    def get_index_info(self) -> dict:
        return {"name": self.get_name(), "dim": self.dim, "max_elements": self.max_elements, "M": self.m, "ef_construction": self.ef_construction, "count": self.get_count()}

    def get_layers(self) -> DataFrame:
        return graph.layer_stats(self.graphs())

    def get_memory_usage(self) -> int:
        """Bytes of the stored files."""
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(self.handle.path) for f in fs)


class DiskANN(_Stored):
    """Squared L2, with up to 8 tags a vector. A deleted vector is found no more, and goes with consolidate_deletes()."""

    def __init__(self, workspace: Workspace, dimensions: int, max_elements: int, R_max_degree: int = 64, is_dynamic: bool = False, name: str = "diskann") -> None:
        if dimensions not in DISKANN_DIMS:
            raise ValueError(f"dimensions must be one of {DISKANN_DIMS}")
        super().__init__(workspace, IndexType.DISKANN, name, dimensions, max_elements, {"R_max_degree": R_max_degree, "is_dynamic": is_dynamic}, False)
        self.degree, self.is_dynamic = R_max_degree, is_dynamic
        self.params = BuildParams()

    def dimensions(self) -> int:
        return self.dim

    def R(self) -> int:
        return self.degree

    def build(self, data: np.ndarray, tags: list[list[int]] | None = None, params: BuildParams | None = None) -> None:
        if tags is not None and len(tags) != len(data):
            raise ValueError("data and tags differ in length")
        for old in (self.path, self._graves, self._graph_path):
            shutil.rmtree(old, ignore_errors=True)
        self.params = params or BuildParams()
        self._append(data, tags, first=0)

    @property
    def _graves(self) -> str:
        return os.path.join(self.handle.path, "tombstones")

    def live(self) -> DataFrame:
        rows = self.vectors()
        return without(rows, self.workspace.spark.read.parquet(self._graves)) if os.path.exists(self._graves) else rows

    def search(self, query: np.ndarray, K: int, params: SearchParams | None = None, approximate: bool = False) -> tuple[np.ndarray, np.ndarray]:
        labels, distances = self.search_knn_parallel(np.atleast_2d(query), K, params, approximate=approximate)
        got = labels[0] >= 0
        return labels[0][got], distances[0][got]

    def search_with_filter(self, query: np.ndarray, label: int, K: int, params: SearchParams | None = None, approximate: bool = False) -> tuple[np.ndarray, np.ndarray]:
        labels, distances = self.search_with_filter_parallel(np.atleast_2d(query), label, K, params, approximate=approximate)
        got = labels[0] >= 0
        return labels[0][got], distances[0][got]

    def search_knn_parallel(self, queries: np.ndarray, K: int, params: SearchParams | None = None, num_threads: int = 0, approximate: bool = False) -> tuple[np.ndarray, np.ndarray]:
        return self._graph(queries, K, params, None) if approximate else self._exact(self.live(), queries, K)

    def search_with_filter_parallel(self, queries: np.ndarray, label: int, K: int, params: SearchParams | None = None, num_threads: int = 0, approximate: bool = False) -> tuple[np.ndarray, np.ndarray]:
        return self._graph(queries, K, params, label) if approximate else self._exact(with_tag(self.live(), label), queries, K)

    def _graph(self, queries: np.ndarray, k: int, params: SearchParams | None, label: int | None) -> tuple[np.ndarray, np.ndarray]:
        build = lambda: graph.build(self.live(), "vamana", tags_col="tags", degree=self.degree, width=self.params.L_build, alpha=self.params.alpha)
        return self._walk(self._stored_graphs(build), queries, k, (params or SearchParams()).L_search, label)

    def _dynamic_only(self) -> None:
        if not self.is_dynamic:
            raise RuntimeError("not possible with a non-dynamic index")

    def insert_point(self, vector: np.ndarray, tags: list[int], external_id: int) -> None:
        self._dynamic_only()
        if self.vectors().filter(F.col("vec_id") == external_id).limit(1).count():
            raise ValueError(f"id exists: {external_id}")
        self._append(np.atleast_2d(vector), [tags], ids=[external_id])

    def lazy_delete(self, external_id: int) -> None:
        self._dynamic_only()
        self.workspace.spark.createDataFrame([(int(external_id),)], "vec_id long").write.mode("append").parquet(self._graves)
        self._forget_graphs()

    def consolidate_deletes(self, params: BuildParams | None = None) -> None:
        """Rewrites the vectors without deleted ones."""
        self._dynamic_only()
        if os.path.exists(self._graves):
            self.live().write.mode("overwrite").parquet(self.path + ".new")
            shutil.rmtree(self.path)
            os.rename(self.path + ".new", self.path)
            shutil.rmtree(self._graves)
            self._forget_graphs()


class IVFPQIndex(_Stored):
    """Squared L2 by inverted lists and product codes; vectors themselves aren't kept once encoded."""

    def __init__(self, workspace: Workspace, max_elements: int, dim: int = 128, num_clusters: int = 256, num_subquantizers: int = 8, retrain_interval: int = 10_000, skip_recovery: bool = False, name: str = "ivfpq") -> None:
        if dim % num_subquantizers:
            raise ValueError("dim must be a multiple of num_subquantizers")
        super().__init__(workspace, IndexType.IVFPQ, name, dim, max_elements, {"num_clusters": num_clusters, "num_subquantizers": num_subquantizers}, skip_recovery)
        self.clusters, self.subquantizers, self.retrain_interval = num_clusters, num_subquantizers, retrain_interval
        self._recovered = self.is_trained() and not skip_recovery
        self._since_training = 0

    @property
    def _model(self) -> str:
        return os.path.join(self.handle.path, "model.pickle")

    @property
    def _codes(self) -> str:
        return os.path.join(self.handle.path, "codes")

    def is_trained(self) -> bool:
        return os.path.exists(self._model)

    def train(self, data: np.ndarray | DataFrame) -> None:
        df = data if isinstance(data, DataFrame) else self.workspace.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.asarray(data, np.float32))], "vec_id long, embedding array<float>")
        model = ivfpq.train(df, self.clusters, self.subquantizers)
        os.makedirs(self.handle.path, exist_ok=True)
        model.save(self._model)
        self._since_training = 0

    def _trained(self) -> ivfpq.Model:
        if not self.is_trained():
            raise RuntimeError("index must be trained first")
        return ivfpq.Model.load(self._model)

    def codes(self) -> DataFrame:
        spark = self.workspace.spark
        return spark.read.parquet(self._codes) if os.path.exists(self._codes) else spark.createDataFrame([], "vec_id long, codes binary, cluster_id int")

    def get_count(self) -> int:
        return self.codes().count()

    def add_points(self, items: np.ndarray) -> list[int]:
        model, x = self._trained(), np.asarray(items, np.float32)
        have = self.get_count()
        if have + len(x) > self.max_elements:
            raise ValueError("index is full")
        rows = [(have + i, v.tolist()) for i, v in enumerate(x)]
        if rows:
            self.add_dataframe(self.workspace.spark.createDataFrame(rows, "vec_id long, embedding array<float>"), model)
        return [r[0] for r in rows]

    def add_dataframe(self, df: DataFrame, model: ivfpq.Model | None = None) -> None:
        """Encodes (vec_id, embedding) on the executors; ids are the caller's."""
        before = self.get_count()
        ivfpq.encode(df, model or self._trained()).write.mode("append").partitionBy("cluster_id").parquet(self._codes)
        self._since_training += self.get_count() - before

    def vectors_since_training(self) -> int:
        """Vectors that this object added since it was trained or opened."""
        return self._since_training

    def needs_training(self) -> bool:
        """Whether retrain_interval vectors came since training. The index itself never retrains: codes of another model would be lost."""
        return self._since_training >= self.retrain_interval

    def search_knn(self, query: np.ndarray, k: int, nprobe: int = 8, stats: bool = False) -> tuple[np.ndarray, np.ndarray]:
        labels, distances = self.search_knn_parallel(np.atleast_2d(query), k, nprobe)
        got = labels[0] >= 0
        return labels[0][got], distances[0][got]

    def search_knn_parallel(self, queries: np.ndarray, k: int, nprobe: int = 8, num_threads: int = 0) -> tuple[np.ndarray, np.ndarray]:
        n = len(np.atleast_2d(queries))
        self._stats["searches"] += n
        self._stats["lists_probed"] = self._stats.get("lists_probed", 0) + n * min(nprobe, self.clusters)
        self._stats["vectors_scanned"] = self._stats.get("vectors_scanned", 0) + self._scanned(queries, nprobe)
        return self._collect(ivfpq.search(self.codes(), self._trained(), self._queries(queries), k, nprobe, qid_col="qid"), n, k)

    def _scanned(self, queries: np.ndarray, nprobe: int) -> int:
        """Vectors in the lists that the queries probe."""
        sizes = np.array(self.list_sizes())
        near = np.argsort(block("l2", np.atleast_2d(np.asarray(queries, np.float64)), self._trained().centroids), axis=1, kind="stable")[:, :nprobe]
        return int(sizes[near].sum())

    def get_stats(self) -> dict:
        sizes = ivfpq.list_sizes(self.codes(), self.clusters)
        avg = sizes.agg(F.avg("size")).first()[0]
        return {**self._stats, "num_vectors": self.get_count(), "num_clusters": self.clusters, "avg_list_size": avg}

    def list_sizes(self) -> list[int]:
        return [r["size"] for r in ivfpq.list_sizes(self.codes(), self.clusters).orderBy("cluster_id").collect()]
