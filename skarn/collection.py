"""Collections: typed documents with vectors, in versioned Parquet snapshots, and their searches.

A version is a list of folders in a manifest; adding appends a folder, updates and deletes rewrite only the
folders that hold the ids. The manifest is replaced atomically, so readers see whole versions.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skarn.catalog import IndexCatalog, IndexConfig, IndexHandle, IndexInfo, IndexType
from skarn.functions.distance import DistanceMetric
from skarn.functions.text import Analyzer
from skarn.operators import hybrid, ivfpq
from skarn.operators.filters import Condition, parse_filter, where
from skarn.operators.knn import knn, knn_join
from skarn.operators.ordered import OrderedIndex
from skarn.operators.text import TextIndex
from skarn.schema import MAX_RECORD_BYTES, FieldType, Schema
from skarn.session import Workspace

RESERVED = ("doc_id", "content", "embedding", "metadata")


@dataclass
class Document:
    id: int
    content: str
    metadata: dict


@dataclass
class SearchResult:
    doc_id: int
    score: float
    vector_score: float = 0.0
    text_score: float = 0.0
    document: Document | None = None

    @property
    def id(self) -> int:
        return self.doc_id


class Collection:
    """Documents (doc_id, content, declared fields, metadata as JSON, embedding).

    Ids are given in order from 0 and never again; a failed add gives none away. Vectors lie with the
    documents, so an index may be created before or after them.
    """

    def __init__(self, workspace: Workspace, name: str, schema: Schema | None = None, vector_dim: int = 0, distance_metric: DistanceMetric | str = DistanceMetric.COSINE) -> None:
        self.workspace, self.catalog = workspace, IndexCatalog(workspace)
        metric = DistanceMetric.parse(distance_metric)
        self._schema = schema or Schema()
        for f in self._schema.fields:
            if f.name in RESERVED:
                raise ValueError(f"field name is reserved: {f.name}")
        config = IndexConfig(vector_dim, metric=metric.value, options={"schema": json.loads(self._schema.to_json())})
        self._attach(self.catalog.create_index(name, IndexType.COLLECTION, config).info)
        os.makedirs(self._path, exist_ok=True)
        self._commit({"version": 0, "next_id": 0, "count": 0, "parts": [], "batches": []})

    @classmethod
    def open(cls, workspace: Workspace, name: str) -> Collection:
        self = cls.__new__(cls)
        self.workspace, self.catalog = workspace, IndexCatalog(workspace)
        info = self.catalog.get_index_info(name)
        if info.type != IndexType.COLLECTION.value:
            raise ValueError(f"not a collection: {name}")
        self._schema = Schema.from_dict(info.config["schema"])
        self._attach(info)
        return self

    def _attach(self, info: IndexInfo) -> None:
        self._info, self._path = info, self.catalog.path_of(info)

    # -- state ---------------------------------------------------------------------------------------

    def _manifest(self) -> dict:
        with open(os.path.join(self._path, "manifest.json")) as f:
            return json.load(f)

    def _commit(self, state: dict) -> None:
        at = os.path.join(self._path, "manifest.json")
        with open(at + ".new", "w") as f:
            json.dump(state, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(at + ".new", at)

    def name(self) -> str:
        return self._info.name

    def schema(self) -> Schema:
        return self._schema

    def vector_dim(self) -> int:
        return self._info.dimensions

    def has_vectors(self) -> bool:
        return self._info.dimensions > 0

    def metric(self) -> DistanceMetric:
        return DistanceMetric.parse(self._info.config["metric"])

    def doc_count(self) -> int:
        return self._manifest()["count"]

    def version(self) -> int:
        return self._manifest()["version"]

    def flush(self) -> None:
        """A barrier only: every call commits before it returns."""

    def table_schema(self) -> T.StructType:
        fields = [T.StructField("doc_id", T.LongType()), T.StructField("content", T.StringType())]
        fields += [*self._schema.struct().fields, T.StructField("metadata", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
        return T.StructType(fields)

    def documents(self) -> DataFrame:
        """The live documents of the current version."""
        return self._read(self._manifest()["parts"])

    def _read(self, parts: list[str]) -> DataFrame:
        spark = self.workspace.spark
        if not parts:
            return spark.createDataFrame([], self.table_schema())
        return spark.read.schema(self.table_schema()).parquet(*[os.path.join(self._path, p) for p in parts])

    # -- writing -------------------------------------------------------------------------------------

    def _rows(self, contents: list[str], metadatas: list[dict], vectors: list | None, ids: list[int]) -> list[tuple]:
        out = []
        for i, ident in enumerate(ids):
            m = metadatas[i]
            self._schema.validate(m)
            v = [float(x) for x in vectors[i]] if vectors is not None and len(vectors) else None
            if v is not None and len(v) != self.vector_dim():
                raise ValueError(f"vector has {len(v)} elements, not {self.vector_dim()}")
            text = json.dumps(m, sort_keys=True, ensure_ascii=False)
            if len(contents[i].encode()) + len(text.encode()) > MAX_RECORD_BYTES:
                raise ValueError("document is too large")
            declared = [float(m[f.name]) if f.type.value == "float" and f.name in m else m.get(f.name) for f in self._schema.fields]
            out.append((ident, contents[i], *declared, text, v))
        return out

    def add(self, contents: list[str], metadatas: list[dict], vectors: list | None = None) -> list[int]:
        """Adds documents after validating all; their ids."""
        if len(contents) != len(metadatas):
            raise ValueError("contents and metadatas differ in length")
        if vectors is not None and len(vectors) and len(vectors) != len(contents):
            raise ValueError("contents and vectors differ in length")
        if vectors is not None and len(vectors) and not self.has_vectors():
            raise ValueError("collection does not support vectors")
        state = self._manifest()
        ids = list(range(state["next_id"], state["next_id"] + len(contents)))
        rows = self._rows(contents, metadatas, vectors, ids)
        self._check_unique(rows=rows)
        if rows:
            self._append(self.workspace.spark.createDataFrame(rows, self.table_schema()), len(rows), state)
        return ids

    def add_dataframe(self, df: DataFrame, order_by: str | None = None, batch_id: int | str | None = None) -> tuple[int, int]:
        """Adds a DataFrame's rows (content, declared fields, embedding; other columns become metadata): the first id, and how many.

        Ids follow order_by, else the order of partitions. A batch_id that was added before adds nothing,
        so that a repeated streaming batch counts once. Declared types are cast on the executors, and
        required fields, vector lengths and values that a cast would lose are checked there in one pass.
        """
        state = self._manifest()
        if batch_id is not None and batch_id in state["batches"]:
            return state["next_id"], 0
        declared = {f.name: f for f in self._schema.fields}
        bad = F.lit(False)
        for f in declared.values():
            c = F.col(f.name) if f.name in df.columns else F.lit(None)
            if f.name in df.columns:
                bad = bad | (c.isNotNull() & c.try_cast(f.type.spark()).isNull())
            if not f.nullable:
                bad = bad | c.isNull()
        if "embedding" in df.columns:
            bad = bad | (F.size("embedding") != self.vector_dim()) & F.col("embedding").isNotNull()
        spare = [c for c in df.columns if c not in RESERVED]
        meta = F.to_json(F.struct(*[F.col(c) for c in sorted(spare)])) if spare else F.lit("{}")
        cols = [F.coalesce(F.col("content"), F.lit("")).alias("content")]
        cols += [(F.col(n).try_cast(f.type.spark()) if n in df.columns else F.lit(None).cast(f.type.spark())).alias(n) for n, f in declared.items()]
        cols += [meta.alias("metadata"), (F.col("embedding") if "embedding" in df.columns else F.lit(None)).cast("array<float>").alias("embedding"), F.coalesce(bad, F.lit(False)).alias("_bad")]
        if order_by and (added := self._add_by_key(df, order_by, cols, state, batch_id)) is not None:
            return added
        rows = df.orderBy(order_by) if order_by else df
        rows = rows.select(*cols).withColumn("_at", F.monotonically_increasing_id())
        staged = self._new_part()
        rows.write.parquet(staged)  # the positions are fixed by being written
        staged_rows = self.workspace.spark.read.parquet(staged)
        counts = staged_rows.groupBy(F.shiftright("_at", 33).alias("_p")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("_bad").cast("int")).alias("bad")).orderBy("_p").collect()
        try:
            if any(r.bad for r in counts):
                raise ValueError("rows don't fit the schema")
            total, first = 0, {}
            for r in counts:
                first[r["_p"]] = total
                total += r.n
            if total:
                shift = self.workspace.spark.createDataFrame([(p, state["next_id"] + n) for p, n in first.items()], "_p long, _first long")
                placed = staged_rows.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(shift), "_p")  # a row for each written partition
                placed = placed.withColumn("doc_id", F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
                self._check_unique(df=placed)
                self._append(placed, total, state, batch_id)
            return state["next_id"] - total, total
        finally:
            shutil.rmtree(staged)

    def _add_by_key(self, df: DataFrame, key: str, cols: list[Column], state: dict, batch_id: int | str | None) -> tuple[int, int] | None:
        """Rows with keys of their own: only keys are sorted, and the rows joined to their places and written once. None, if a key is null or there twice."""
        spark, staged = self.workspace.spark, self._new_part()
        df.select(F.col(key).alias("_key")).orderBy("_key").withColumn("_at", F.monotonically_increasing_id()).write.parquet(staged)
        try:
            keys = spark.read.parquet(staged).withColumn("_p", F.shiftright("_at", 33))
            if keys.groupBy("_key").count().filter("count > 1 or _key is null").limit(1).count():
                return None
            if df.select(*cols).agg(F.max(F.col("_bad").cast("int"))).first()[0]:
                raise ValueError("rows don't fit the schema")
            total, first = 0, []
            for r in keys.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect():
                first.append((r["_p"], state["next_id"] + total))
                total += r.n
            if total:
                shift = F.broadcast(spark.createDataFrame(first, "_p long, _first long"))  # a row for each written partition
                ids = keys.join(shift, "_p").select("_key", (F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("_id"))
                placed = df.join(ids, F.col(key) == F.col("_key")).select(*cols, F.col("_id").alias("doc_id"))
                self._check_unique(df=placed)
                self._append(placed, total, state, batch_id)
            return state["next_id"] - total, total
        finally:
            shutil.rmtree(staged)

    def _new_part(self) -> str:
        return os.path.join(self._path, f"part-{uuid.uuid4().hex}")

    def _append(self, rows: DataFrame, n: int, state: dict, batch_id: int | str | None = None) -> None:
        at = self._new_part()
        rows.select([F.col(f.name).cast(f.dataType) for f in self.table_schema()]).write.parquet(at)
        state["parts"].append(os.path.basename(at))
        state["next_id"] += n
        state["count"] += n
        state["version"] += 1
        if batch_id is not None:
            state["batches"].append(batch_id)
        self._commit(state)

    def _check_unique(self, rows: list[tuple] | None = None, df: DataFrame | None = None) -> None:
        """Unique indices hold for the documents there are and the new ones."""
        for info in self.catalog.list_indexes(self.name()):
            if info.type == IndexType.BTREE.value and info.config.get("unique"):
                fields = info.config["fields"]
                new = df if df is not None else self.workspace.spark.createDataFrame(rows, self.table_schema())
                both = self.documents().select(fields).unionByName(new.select(fields)).dropna()
                if both.groupBy(*fields).count().filter("count > 1").limit(1).count():
                    raise ValueError(f"duplicate key for unique index {info.name}")

    def get(self, ids: list[int]) -> list[Document]:
        """The documents in the order of ids; a missing id gives an empty document."""
        want = self.workspace.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "doc_id long") if ids else None
        found = {r.doc_id: r for r in self.documents().join(F.broadcast(want), "doc_id").collect()} if ids else {}  # as many rows as ids given
        return [Document(i, found[i].content, json.loads(found[i].metadata)) if i in found else Document(i, "", {}) for i in ids]

    def get_where(self, filter: str | dict | Condition, limit: int = 100, offset: int = 0) -> list[Document]:
        rows = self.filtered(filter).orderBy("doc_id").offset(offset).limit(limit).collect()
        return [Document(r.doc_id, r.content, json.loads(r.metadata)) for r in rows]

    def filtered(self, filter: str | dict | Condition | None, strict: bool = False) -> DataFrame:
        return where(self.documents(), filter, "metadata", strict)

    def _rewrite(self, touched: Column, change) -> int:
        """Replaces the parts that hold touched rows. The others stay as they are."""
        state = self._manifest()
        n, parts = 0, []
        for p in state["parts"]:
            rows = self._read([p])
            hits = rows.filter(touched).count()
            if not hits:
                parts.append(p)
                continue
            n += hits
            new = change(rows)
            if new is not None:
                at = self._new_part()
                new.write.parquet(at)
                parts.append(os.path.basename(at))
        state["parts"], state["version"] = parts, state["version"] + 1
        self._state = state
        return n

    def update(self, ids: list[int], metadatas: list[dict]) -> None:
        """Merges keys into the documents' metadata, at the top level, and validates the result."""
        if len(ids) != len(metadatas):
            raise ValueError("ids and metadatas differ in length")
        if not ids:
            return
        spark, want = self.workspace.spark, {}
        for i, m in zip(ids, metadatas):
            want[i] = {**want.get(i, {}), **m}
        old = {r.doc_id: r for r in self.documents().filter(F.col("doc_id").isin(list(want))).select("doc_id", "metadata").collect()}
        missing = [i for i in want if i not in old]
        if missing:
            raise KeyError(f"Document not found: {missing[0]}")
        merged = {i: {**json.loads(old[i].metadata), **m} for i, m in want.items()}
        rows = self._rows([""] * len(merged), list(merged.values()), None, list(merged))
        patch = spark.createDataFrame(rows, self.table_schema())
        names = [f.name for f in self._schema.fields] + ["metadata"]
        patch = F.broadcast(patch.select(F.col("doc_id").alias("_id"), *[F.col(n).alias(f"_{n}") for n in names]))  # as many rows as ids given

        def change(part: DataFrame) -> DataFrame:
            both = part.join(patch, part.doc_id == patch["_id"], "left")
            return both.select([F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in part.columns])

        self._rewrite(F.col("doc_id").isin(list(want)), change)
        self._commit(self._state)

    def delete(self, ids: list[int]) -> int:
        """Deletes documents; how many there were."""
        return self._delete(F.col("doc_id").isin([int(i) for i in ids])) if ids else 0

    def delete_where(self, filter: str | dict | Condition) -> int:
        from skarn.operators.filters import matches

        return self._delete(matches(filter, self.table_schema(), "metadata"))

    def _delete(self, cond: Column) -> int:
        n = self._rewrite(cond, lambda part: part.filter(~cond))
        if n:
            self._state["count"] -= n
            self._commit(self._state)
        return n

    def compact(self) -> None:
        """Writes all live documents into one part and removes files that no version lists."""
        state = self._manifest()
        if len(state["parts"]) > 1:
            at = self._new_part()
            self.documents().write.parquet(at)
            state["parts"], state["version"] = [os.path.basename(at)], state["version"] + 1
            self._commit(state)
        for entry in os.listdir(self._path):
            if entry.startswith("part-") and entry not in state["parts"]:
                shutil.rmtree(os.path.join(self._path, entry))
        for info in self.catalog.list_indexes(self.name()):
            at = self.catalog.path_of(info)
            if info.type == IndexType.TEXT.value and os.path.exists(at):
                for entry in set(os.listdir(at)) - set(state["parts"]):
                    shutil.rmtree(os.path.join(at, entry))

    # -- indices -------------------------------------------------------------------------------------

    def _create(self, name: str, kind: IndexType, options: dict) -> IndexHandle:
        config = IndexConfig(self.vector_dim(), metric=self.metric().value, options=options)
        return self.catalog.create_index(name, kind, config, self.name())

    def _vectors_only(self) -> None:
        if not self.has_vectors():
            raise ValueError("collection does not support vectors")

    def create_hnsw_index(self, name: str, M: int = 16, ef_construction: int = 200) -> IndexHandle:
        self._vectors_only()
        return self._create(name, IndexType.HNSW, {"M": M, "ef_construction": ef_construction})

    def create_diskann_index(self, name: str, R_max_degree: int = 64, L_build: int = 100, alpha: float = 1.2) -> IndexHandle:
        self._vectors_only()
        return self._create(name, IndexType.DISKANN, {"R_max_degree": R_max_degree, "L_build": L_build, "alpha": alpha})

    def create_ivfpq_index(self, name: str, num_clusters: int = 256, num_subquantizers: int = 8, nprobe: int = 8) -> IndexHandle:
        """Trains on the documents there are and writes their codes. Searches look at documents added later one by one, until the index is made anew."""
        self._vectors_only()
        rows = self.documents().filter("embedding is not null")
        model = ivfpq.train(rows, num_clusters, num_subquantizers, id_col="doc_id")
        handle = self._create(name, IndexType.IVFPQ, {"num_clusters": num_clusters, "num_subquantizers": num_subquantizers, "nprobe": nprobe})
        os.makedirs(handle.path, exist_ok=True)
        model.save(os.path.join(handle.path, "model.pickle"))
        ivfpq.encode(rows, model, id_col="doc_id").write.partitionBy("cluster_id").parquet(os.path.join(handle.path, "codes"))
        return handle

    def create_text_index(self, name: str, analyzer: Analyzer | str = Analyzer.STANDARD, k1: float = 1.2, b: float = 0.75, fields: list[str] | None = None, language: str = "english") -> IndexHandle:
        """fields are `content` (the default) and declared string fields, indexed as one text. language is kept; the stop words are English ones whatever it is."""
        fields = list(fields or ["content"])
        for f in fields:
            if f != "content" and (not self._schema.has_field(f) or self._schema.get_field(f).type is not FieldType.STRING):
                raise ValueError(f"not a string field: {f}")
        return self._create(name, IndexType.TEXT, {"analyzer": Analyzer(analyzer).value, "k1": k1, "b": b, "fields": fields, "language": language})

    def create_metadata_index(self, name: str, fields: list[str], unique: bool = False) -> IndexHandle:
        """A layout and a constraint; creating it again is no error."""
        if self.catalog.index_exists(name):
            return self.catalog.open_index(name)
        for f in fields:
            if not self._schema.has_field(f):
                raise ValueError(f"Field {f} not in schema")
        if unique and OrderedIndex(self.documents(), fields).duplicates().limit(1).count():
            raise ValueError(f"duplicate key for unique index {name}")
        return self._create(name, IndexType.BTREE, {"fields": list(fields), "unique": unique})

    def create_btree_index(self, name: str, field: str, unique: bool = False) -> IndexHandle:
        return self.create_metadata_index(name, [field], unique)

    def list_indices(self) -> list[dict]:
        return [{"index_id": i.index_id, "name": i.name, "type": i.type, "status": i.status, "config": i.config} for i in self.catalog.list_indexes(self.name())]

    def drop_index(self, name: str) -> None:
        self._index(name)
        self.catalog.drop_index(name)

    def _index(self, name: str, *kinds: IndexType) -> IndexInfo:
        if not self.catalog.index_exists(name) or self.catalog.get_index_info(name).collection != self.name():
            raise KeyError(f"Index not found: {name}")
        info = self.catalog.get_index_info(name)
        if kinds and info.type not in [k.value for k in kinds]:
            raise ValueError(f"{name} is not a {'vector' if IndexType.HNSW in kinds else kinds[0].value} index")
        return info

    def metadata_index(self, name: str) -> OrderedIndex:
        info = self._index(name, IndexType.BTREE)
        return OrderedIndex(self.documents(), info.config["fields"], "doc_id", info.config["unique"])

    def text_index(self, name: str) -> TextIndex:
        """The inverted index of the current version. Each part of the documents is indexed once, in files of its own,
        so that a write costs its own documents; files of parts that are gone stay for their readers until compact()."""
        info = self._index(name, IndexType.TEXT)
        args = (info.config["analyzer"], info.config["k1"], info.config["b"])
        text = F.concat_ws("\n", *[F.col(f) for f in info.config.get("fields", ["content"])])
        paths = [os.path.join(self.catalog.path_of(info), p) for p in self._manifest()["parts"]]
        for at in paths:
            if not os.path.exists(os.path.join(at, "lengths", "_SUCCESS")):
                TextIndex.build(self._read([os.path.basename(at)]).select("doc_id", text.alias("_text")), "doc_id", "_text", *args).write(at)
        return TextIndex.read(self.workspace.spark, paths, *args)

    # -- searching -----------------------------------------------------------------------------------

    def vector_ranking(self, query: list[float], index: str, k: int, filter: str | dict | Condition | None = None) -> DataFrame:
        """rank, doc_id and distance (lower is nearer) of the k nearest documents that match the filter."""
        self._vectors_only()
        info = self._index(index, IndexType.HNSW, IndexType.DISKANN, IndexType.IVFPQ)
        if len(query) != self.vector_dim():
            raise ValueError(f"query has {len(query)} elements, not {self.vector_dim()}")
        rows = self.filtered(filter).filter("embedding is not null")
        if info.type == IndexType.IVFPQ.value and parse_filter(filter).op == "$true" and self.metric() is DistanceMetric.L2:
            at, spark = self.catalog.path_of(info), self.workspace.spark
            one = spark.createDataFrame([(0, [float(x) for x in query])], "vec_id long, embedding array<double>")
            listed = spark.read.parquet(os.path.join(at, "codes"))
            codes = listed.join(rows.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
            found = ivfpq.search(codes, ivfpq.Model.load(os.path.join(at, "model.pickle")), one, k, info.config["nprobe"], vectors=rows, id_col="doc_id").select(F.col("id").alias("doc_id"), "distance")
            new = rows.join(listed.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")  # not listed yet
            both = found.unionAll(knn(new, query, k, self.metric(), id_col="doc_id").select("doc_id", "distance"))
            top = both.orderBy("distance", "doc_id").limit(k)
            return top.select(F.row_number().over(Window.orderBy("distance", "doc_id")).alias("rank"), "doc_id", "distance")
        return knn(rows.select("doc_id", "embedding"), query, k, self.metric(), id_col="doc_id").select("rank", "doc_id", "distance")

    def search_vector_batch(self, queries: DataFrame, k: int, filter: str | dict | Condition | None = None) -> DataFrame:
        """qid, rank, id, distance for queries (qid, embedding)."""
        self._vectors_only()
        return knn_join(queries, self.filtered(filter), k, self.metric(), qid_col="qid", id_col="doc_id")

    def text_ranking(self, query: str, index: str, k: int, filter: str | dict | Condition | None = None) -> DataFrame:
        """rank, doc_id and score; the filter restricts documents, not the corpus statistics."""
        ids = None if parse_filter(filter).op == "$true" else self.filtered(filter).select("doc_id")
        return self.text_index(index).search(query, k, ids)

    def hybrid_ranking(self, vector: list[float], vector_index: str, text: str, text_index: str, k: int, fusion: hybrid.FusionParams | None = None, filter: str | dict | Condition | None = None) -> DataFrame:
        """rank, doc_id, score, vector_score, text_score from the best 2k of both searches."""
        return hybrid.fuse(self.vector_ranking(vector, vector_index, 2 * k, filter), self.text_ranking(text, text_index, 2 * k, filter), k, fusion)

    def _results(self, ranking: DataFrame, make) -> list[SearchResult]:
        rows = ranking.join(self.documents().select("doc_id", "content", "metadata"), "doc_id", "left").orderBy("rank").collect()
        return [make(r, Document(r.doc_id, r.content, json.loads(r.metadata))) for r in rows]

    def search_vector(self, query: list[float], index: str, k: int = 10, filter: str | dict | Condition | None = None, ef_search: int = 100) -> list[SearchResult]:
        """The search is exact, so ef_search has no effect. Scores are distances."""
        return self._results(self.vector_ranking(query, index, k, filter), lambda r, d: SearchResult(r.doc_id, r.distance, r.distance, 0.0, d))

    def search_text(self, query: str, index: str, k: int = 10, filter: str | dict | Condition | None = None) -> list[SearchResult]:
        return self._results(self.text_ranking(query, index, k, filter), lambda r, d: SearchResult(r.doc_id, r.score, 0.0, r.score, d))

    def search_hybrid(self, vector: list[float], vector_index: str, text: str, text_index: str, k: int = 10, fusion: hybrid.FusionParams | None = None, filter: str | dict | Condition | None = None) -> list[SearchResult]:
        ranking = self.hybrid_ranking(vector, vector_index, text, text_index, k, fusion, filter)
        return self._results(ranking, lambda r, d: SearchResult(r.doc_id, r.score, r.vector_score, r.text_score, d))
