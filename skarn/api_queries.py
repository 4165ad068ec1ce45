"""Registered queries that call the engine's own objects: collections, indices, catalog, readers, streams, settings.

Each has DuckDB SQL for what the calls must give. Those that only read share one stored collection a session and data folder.
"""

from __future__ import annotations

import json
import math
import os

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.catalog import DiskANNConfig, HNSWConfig, IndexCatalog, IndexStatus, IndexType
from skarn.collection import Collection
from skarn.functions.distance import DistanceMetric, inner_product, normalised
from skarn.functions.generate import fnv1a, zipf_column
from skarn.indices import DiskANN, HnswIndex, IVFPQIndex
from skarn.operators import graph, ivfpq
from skarn.operators.filters import from_match_range, parse_filter, parse_legacy, selectivity, where
from skarn.operators.hybrid import FusionMethod, FusionParams
from skarn.operators.knn import knn_join
from skarn.operators.stored import DocIdIndex, LogTable, MetadataIndex
from skarn.plans import evaluate, oltp
from skarn.plans.layout import dealt, scratch_folder
from skarn.queries import INDEX, NPROBE, TAGGED, V, _bm25_sql, _hybrid_sql, _join_sql, first_vector, query, query_set, rounded, sql_distance, table, tagged
from skarn.schema import Schema
from skarn.session import LogLevel, Workspace, buffer_config
from skarn.sources.vectors import read_filtered_benchmark, read_vectors, write_vectors
from skarn.streaming.ingest import stream_into

_shared: dict[tuple[str, str], Collection] = {}
FIELDS = {"lang": "string", "n_chars": "int", "source": "string"}


def _contents(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), "lang", "n_chars", "source")
    return docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left") if vectors else docs


def _workspace(spark: SparkSession) -> Workspace:
    return Workspace(spark, scratch_folder(spark), True)


def _fresh(spark: SparkSession, sf_dir: str) -> Collection:
    """A collection of all documents for one query to change."""
    c = Collection(_workspace(spark), "docs", Schema.from_dict(FIELDS))
    c.add_dataframe(_contents(spark, sf_dir), order_by="doc_id")
    return c


def shared(spark: SparkSession, sf_dir: str) -> Collection:
    """All documents with the vectors there are, and an index of each kind, for queries that only read."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _shared:
        c = Collection(_workspace(spark), "docs", Schema.from_dict(FIELDS), vector_dim=64, distance_metric="cosine")
        c.add_dataframe(_contents(spark, sf_dir, True), order_by="doc_id")
        c.create_hnsw_index("v")
        c.create_diskann_index("g")
        c.create_text_index("t")
        c.create_metadata_index("by_lang", ["lang", "n_chars"])
        _shared[at] = c
    return _shared[at]


def _round4(x: float) -> float:
    """Half away from zero, as SQL rounds; Python's round() takes the even digit."""
    return math.copysign(math.floor(abs(x) * 10_000 + 0.5) / 10_000, x)


def _results(spark: SparkSession, found: list, extra: bool = False) -> DataFrame:
    rows = [(i + 1, r.doc_id, _round4(r.score), _round4(r.vector_score), _round4(r.text_score), r.document.metadata["lang"]) for i, r in enumerate(found)]
    df = spark.createDataFrame(rows, "rank int, doc_id long, score double, vector_score double, text_score double, lang string")
    return df if extra else df.drop("vector_score", "text_score")


def _one(spark: SparkSession, **values: object) -> DataFrame:
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


# -- collections ---------------------------------------------------------------------------------------------


@query("SELECT i.pos, i.doc_id::BIGINT AS doc_id, coalesce(d.lang, '') AS lang, length(coalesce(d.text, ''))::BIGINT AS n FROM (VALUES (0, 5), (1, 3), (2, 999999999), (3, 5)) i(pos, doc_id) LEFT JOIN documents d ON d.doc_id = i.doc_id")
def collection_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shared(spark, sf_dir).get([5, 3, 999_999_999, 5])
    return spark.createDataFrame([(i, d.id, d.metadata.get("lang", ""), len(d.content)) for i, d in enumerate(got)], "pos int, doc_id long, lang string, n long")


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'de' AND n_chars > 300 ORDER BY doc_id LIMIT 50 OFFSET 10")
def collection_get_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shared(spark, sf_dir).get_where({"lang": "de", "n_chars": {"$gt": 300}}, 50, 10)
    return spark.createDataFrame([(d.id, d.metadata["n_chars"]) for d in got], "doc_id long, n_chars long")


@query("SELECT doc_id, CASE WHEN doc_id IN (1, 4, 7) THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id IN (1, 4, 7) THEN doc_id + 5 ELSE n_chars END AS n_chars, CASE WHEN doc_id = 4 THEN 'yes' END AS note FROM documents")
def collection_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of three documents change, one gets a key that isn't declared, all others stay."""
    c = _fresh(spark, sf_dir)
    c.update([1, 4, 7], [{"lang": "xx", "n_chars": 6}, {"lang": "xx", "n_chars": 9, "note": "yes"}, {"lang": "xx", "n_chars": 12}])
    return c.documents().select("doc_id", "lang", "n_chars", F.get_json_object("metadata", "$.note").alias("note"))


@query("SELECT doc_id, lang, 2::BIGINT AS by_ids, (SELECT count(*) FROM documents WHERE lang = 'fr' AND n_chars < 500 AND doc_id NOT IN (2, 6)) AS by_filter, (SELECT count(*) FROM documents WHERE NOT coalesce(lang = 'fr' AND n_chars < 500, false) AND doc_id NOT IN (2, 6)) AS n FROM documents WHERE NOT coalesce(lang = 'fr' AND n_chars < 500, false) AND doc_id NOT IN (2, 6)")
def collection_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _fresh(spark, sf_dir)
    by_ids, by_filter = c.delete([2, 6, 888_888_888]), c.delete_where({"lang": "fr", "n_chars": {"$lt": 500}})
    return c.documents().select("doc_id", "lang", F.lit(by_ids).cast("long").alias("by_ids"), F.lit(by_filter).cast("long").alias("by_filter"), F.lit(c.doc_count()).cast("long").alias("n"))


@query("SELECT count(*) AS doc_count, 64::BIGINT AS vector_dim, true AS has_vectors, 'docs' AS name, 'cosine' AS metric, 'lang,n_chars,source' AS fields FROM documents")
def collection_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = shared(spark, sf_dir)
    return _one(spark, doc_count=c.doc_count(), vector_dim=c.vector_dim(), has_vectors=c.has_vectors(), name=c.name(), metric=c.metric().value, fields=",".join(sorted(f.name for f in c.schema().fields)))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def collection_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection as another object finds it in the folder."""
    return Collection.open(shared(spark, sf_dir).workspace, "docs").documents().groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def _vector_sql(cond: str, k: int) -> str:
    return f"""
        WITH d AS (SELECT doc_id, lang, {sql_distance("cosine", "embedding::DOUBLE[]", V)} AS distance FROM embeddings JOIN documents ON doc_id = vec_id WHERE {cond}),
             r AS (SELECT row_number() OVER (ORDER BY distance, doc_id)::INT AS rank, * FROM d)
        SELECT rank, doc_id, round(distance, 4) + 0 AS score, lang FROM r WHERE rank <= {k}
    """


@query(_vector_sql("true", 10))
def collection_search_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, shared(spark, sf_dir).search_vector(first_vector(spark, sf_dir), "v", 10))


@query(_vector_sql("lang IN ('de', 'fr')", 12))
def collection_search_vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the other kind of graph index; the filter comes first."""
    return _results(spark, shared(spark, sf_dir).search_vector(first_vector(spark, sf_dir), "g", 12, {"lang": {"$in": ["de", "fr"]}}))


@query(_join_sql("cosine", 5, "v.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"))
def collection_search_vector_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = query_set(spark, sf_dir).select(F.col("vec_id").alias("qid"), "embedding")
    return rounded(shared(spark, sf_dir).search_vector_batch(queries, 5, {"lang": "en"}), "distance")


def _text_sql(words: str, k: int, cond: str) -> str:
    return f"SELECT rank, doc_id, score, lang FROM ({_bm25_sql(words, k, cond)}) JOIN documents USING (doc_id)"


@query(_text_sql("license version thing", 10, "true"))
def collection_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, shared(spark, sf_dir).search_text("license version thing", "t", 10))


@query(_text_sql("license version thing", 8, "lang = 'en'"))
def collection_search_text_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter restricts documents, not the statistics of the corpus."""
    return _results(spark, shared(spark, sf_dir).search_text("license version thing", "t", 8, {"lang": "en"}))


def _hybrid(spark: SparkSession, sf_dir: str, fusion: FusionParams) -> DataFrame:
    return _results(spark, shared(spark, sf_dir).search_hybrid(first_vector(spark, sf_dir), "v", "erst thing version", "t", 10, fusion), True)


def _hybrid_of_collection(score: str) -> str:
    sql = _hybrid_sql(score).replace("AS distance FROM embeddings)", "AS distance FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))")
    return f"SELECT rank, doc_id, score, vector_score, text_score, lang FROM ({sql}) JOIN documents USING (doc_id)"


@query(_hybrid_of_collection("coalesce(1.0 / (60 + vr), 0) + coalesce(1.0 / (60 + tr), 0)"))
def collection_search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, FusionParams())


@query(_hybrid_of_collection("coalesce(1 - vnorm, 0) * 0.75 + coalesce(tnorm, 0) * 0.25"))
def collection_search_hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, FusionParams(FusionMethod.WEIGHTED, vector_weight=3.0, text_weight=1.0))


@query(f"WITH {INDEX.replace('FROM documents', 'FROM documents WHERE NOT coalesce(lang = ' + chr(39) + 'fr' + chr(39) + ', false)')} SELECT (SELECT count(*) FROM df) AS vocab_size, n AS doc_count, (SELECT sum(doc_len) FROM dl)::BIGINT AS total_doc_length, round(avgdl, 4) AS avg_doc_len, 'content,english,standard' AS options FROM st")
def collection_text_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted documents leave the text index: its parts are rebuilt where documents went, and only there."""
    c = _fresh(spark, sf_dir)
    c.create_text_index("t")
    c.text_index("t")
    c.delete_where({"lang": "fr"})
    config = c.list_indices()[0]["config"]
    options = ",".join([*config["fields"], config["language"], config["analyzer"]])
    return rounded(c.text_index("t").stats(), "avg_doc_len").withColumn("options", F.lit(options))


@query(
    """
    SELECT doc_id, lang, n_chars, (SELECT count(*) FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL) AS entries,
           EXISTS (SELECT 1 FROM documents WHERE lang = 'de' AND n_chars = 1) AS has_one, true AS same, true AS refused
    FROM documents WHERE lang = 'de' AND n_chars >= 200 AND n_chars < 4000
    """
)
def collection_metadata_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composite index: a prefix range, its entries, a key, and what creating it again and with an unknown field does."""
    c = shared(spark, sf_dir)
    index = c.metadata_index("by_lang")
    same = c.create_metadata_index("by_lang", ["lang", "n_chars"]).index_id == c.catalog.open_index("by_lang").index_id
    try:
        c.create_btree_index("bad", "absent")
        refused = False
    except ValueError:
        refused = True
    got = index.prefix_range_scan(["de"], 200, 4000, True, False).select("doc_id", "lang", "n_chars")
    return got.select("*", F.lit(index.entry_count()).cast("long").alias("entries"), F.lit(index.contains("de", 1)).alias("has_one"), F.lit(same).alias("same"), F.lit(refused).alias("refused"))


@query("SELECT * FROM (VALUES ('v', 'hnsw', 'active'), ('t', 'text', 'active')) t(name, type, status)")
def collection_list_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After one of three is dropped. An index of another collection and an unknown name raise."""
    c = Collection(_workspace(spark), "c", Schema.from_dict({"year": "int"}), vector_dim=4)
    c.create_hnsw_index("v")
    c.create_btree_index("y", "year")
    c.create_text_index("t")
    c.drop_index("y")
    return spark.createDataFrame([(i["name"], i["type"], i["status"]) for i in c.list_indices()], "name string, type string, status string")


@query("SELECT * FROM (VALUES ('hnsw without vectors', 'collection does not support vectors'), ('vector search by text index', 't is not a vector index'), ('unknown index', 'Index not found: none'), ('short query', 'query has 3 elements, not 4'), ('second collection', 'Index already exists: c')) t(call, error)")
def collection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _workspace(spark)
    c, plain = Collection(ws, "c", vector_dim=4), Collection(ws, "plain")
    c.create_text_index("t")
    c.create_hnsw_index("v")
    calls = {
        "hnsw without vectors": lambda: plain.create_hnsw_index("h"),
        "vector search by text index": lambda: c.search_vector([0.0] * 4, "t"),
        "unknown index": lambda: c.search_vector([0.0] * 4, "none"),
        "short query": lambda: c.search_vector([0.0] * 3, "v"),
        "second collection": lambda: Collection(ws, "c"),
    }
    rows = []
    for name, call in calls.items():
        try:
            call()
        except (ValueError, KeyError) as e:
            rows.append((name, str(e.args[0])))
    return spark.createDataFrame(rows, "call string, error string")


@query("SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS ids, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def stream_into_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files; the same stream started again adds nothing."""
    c = Collection(_workspace(spark), "docs", Schema.from_dict(FIELDS))
    kinds = table(spark, sf_dir, "documents").schema
    for _ in range(2):
        stream = spark.readStream.schema(kinds).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern, since a stream's path may be a folder of files but not a file
        stream_into(stream.select(F.col("text").alias("content"), "lang", "n_chars", "source"), c, c.workspace.path("checkpoint")).awaitTermination()
    return c.documents().groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids"), F.sum("n_chars").alias("chars"))


# -- vector indices -------------------------------------------------------------------------------------------


def _vectors(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A query set for calls that take arrays."""
    rows = sorted((r.vec_id, list(r.embedding)) for r in queries.select("vec_id", "embedding").collect())
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def _long(spark: SparkSession, ids: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    rows = [(int(q), n + 1, int(i), round(float(d), 3)) for q, ls, ds in zip(ids, *found) for n, (i, d) in enumerate(zip(ls, ds))]
    return spark.createDataFrame(rows, "qid long, rank int, id long, distance double")


def _index_sql(k: int, cond: str = "true") -> str:
    return _join_sql("l2", k, cond).replace("round(distance, 4)", "round(distance::FLOAT::DOUBLE, 3)")


@query(_index_sql(10))
def hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HnswIndex.search_knn_parallel over stored vectors; exact."""
    index = HnswIndex(_workspace(spark), 1 << 40, 64)
    index.add_dataframe(table(spark, sf_dir, "embeddings"))
    ids, x = _vectors(query_set(spark, sf_dir))
    return _long(spark, ids, index.search_knn_parallel(x, 10))


@query("SELECT count(*) AS n, true AS recovered, false AS skipped, 0::BIGINT AS left_over, true AS full_raises, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS searches, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) * count(*) AS dist_comps FROM embeddings")
def hnsw_recovery_and_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index opened again has its vectors; with skip_recovery or other parameters it starts anew. Counters count exact searches."""
    ws = _workspace(spark)
    HnswIndex(ws, 1 << 40, 64).add_dataframe(table(spark, sf_dir, "embeddings"))
    again = HnswIndex(ws, 1 << 40, 64)
    n, recovered = again.get_count(), again.was_recovered()
    again.search_knn_parallel(_vectors(query_set(spark, sf_dir))[1], 3)
    stats = again.get_stats()
    skipped = HnswIndex(ws, 1, 64, skip_recovery=True)
    left = skipped.get_count()
    skipped.add_points(np.zeros((1, 64)))
    try:
        skipped.add_points_with_ids(np.zeros((1, 64)), [7])
        full = False
    except ValueError:
        full = True
    return _one(spark, n=n, recovered=recovered, skipped=skipped.was_recovered(), left_over=left, full_raises=full, searches=stats["searches"], dist_comps=stats["dist_comps"])


@query("SELECT count(*) AS nodes, true AS recall_reached, true AS fewer_distances, true AS has_hops FROM embeddings")
def hnsw_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layered graphs: every vector is in layer 0, recall@10 of the query set is 0.9 at least, and a search takes fewer distances than a scan."""
    index = HnswIndex(_workspace(spark), 1 << 40, 64, M=12, ef_construction=48)
    index.add_dataframe(table(spark, sf_dir, "embeddings"))
    ids, x = _vectors(query_set(spark, sf_dir))
    found = _long(spark, ids, index.search_knn_parallel(x, 10, 64, approximate=True))
    recall = evaluate.mean_recall(found, knn_join(query_set(spark, sf_dir), table(spark, sf_dir, "embeddings"), 10, "l2"), 10)
    stats, layers = index.get_stats(), {r.layer: r.nodes for r in index.get_layers().collect()}
    return _one(spark, nodes=layers[0], recall_reached=recall >= 0.9, fewer_distances=0 < stats["dist_comps"] < len(ids) * index.get_count(), has_hops=stats["search_hops"] > 0)


@query(_index_sql(6, "list_contains([v.label, v.label + 10, v.vec_id % 7 + 20], 22) AND v.vec_id NOT IN (3, 10)"))
def diskann_filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by tag, after two vectors were deleted, one inserted and deleted, and the deleted ones dropped."""
    index = DiskANN(_workspace(spark), 64, 1 << 40, is_dynamic=True)
    index.add_dataframe(tagged(spark, sf_dir), tags_col="tags")
    index.insert_point(np.zeros(64), [22], 10**9)
    for i in (3, 10, 10**9):
        index.lazy_delete(i)
    index.consolidate_deletes()
    ids, x = _vectors(query_set(spark, sf_dir))
    return _long(spark, ids, index.search_with_filter_parallel(x, 22, 6))


@query(f"SELECT count(*) AS n, true AS recall_reached, true AS refused FROM ({TAGGED}) WHERE list_contains(tags, 22)")
def diskann_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat graph by tag: recall@10 of the query set is 0.9 at least. A vector with nine tags is refused, not cut."""
    index = DiskANN(_workspace(spark), 64, 1 << 40, R_max_degree=16)
    index.add_dataframe(tagged(spark, sf_dir), tags_col="tags")
    index.params.L_build = 32
    ids, x = _vectors(query_set(spark, sf_dir))
    found = _long(spark, ids, index.search_with_filter_parallel(x, 22, 10, approximate=True))
    rows = where(tagged(spark, sf_dir), {"tags": {"$contains": 22}})
    recall = evaluate.mean_recall(found, knn_join(query_set(spark, sf_dir), rows, 10, "l2"), 10)
    try:
        index.build(np.zeros((1, 64)), [list(range(9))])
        refused = False
    except ValueError:
        refused = True
    return _one(spark, n=rows.count(), recall_reached=recall >= 0.9, refused=refused)


@query(_join_sql("l2", 10))
def ivfpq_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all lists probed and all their vectors ranked by exact distances, the answer is exact."""
    rows = table(spark, sf_dir, "embeddings")
    model = ivfpq.train(rows, 16, 8)
    return rounded(ivfpq.search(ivfpq.encode(rows, model), model, query_set(spark, sf_dir), 10, 16, vectors=rows), "distance")


@query("SELECT count(*) AS n, 16::BIGINT AS lists, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) * 16 AS lists_probed, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) * count(*) AS vectors_scanned, true AS untrained_raises, true AS needs_training, round(count(*) / 16.0, 4)::DOUBLE AS avg_list_size FROM embeddings")
def ivfpq_index_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    index = IVFPQIndex(_workspace(spark), 1 << 40, 64, 16, 8, retrain_interval=100)
    try:
        index.add_points(np.zeros((1, 64)))
        raises = False
    except RuntimeError:
        raises = True
    index.train(rows)
    index.add_dataframe(rows)
    labels, _ = index.search_knn_parallel(_vectors(query_set(spark, sf_dir))[1], 5, 16)
    stats = index.get_stats()
    return _one(spark, n=sum(index.list_sizes()), lists=len(index.list_sizes()), lists_probed=stats["lists_probed"], vectors_scanned=stats["vectors_scanned"], untrained_raises=raises and bool((labels >= 0).all()), needs_training=index.needs_training(), avg_list_size=round(float(stats["avg_list_size"]), 4))


@query("SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS queries, true AS recall_reached")
def ivfpq_recall_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate search at its registered nprobe: recall@10 of the query set is 0.9 at least."""
    rows, queries = table(spark, sf_dir, "embeddings"), query_set(spark, sf_dir)
    model = ivfpq.train(rows, 16, 8)
    found = ivfpq.search(ivfpq.encode(rows, model), model, queries, 10, NPROBE, vectors=rows)
    recall = evaluate.mean_recall(found, knn_join(queries, rows, 10, "l2"), 10)
    return _one(spark, queries=queries.count(), recall_reached=recall >= 0.9)


@query("SELECT * FROM (VALUES ('l2', 'l2'), ('fast_l2', 'l2'), ('ip', 'ip'), ('INNER_PRODUCT', 'ip'), ('Cosine', 'cosine'), ('manhattan', 'unknown metric: manhattan')) t(name, metric)")
def distance_metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parse(name: str) -> str:
        try:
            return DistanceMetric.parse(name).value
        except ValueError as e:
            return str(e)

    names = ("l2", "fast_l2", "ip", "INNER_PRODUCT", "Cosine", "manhattan")
    return spark.createDataFrame([(n, parse(n)) for n in names], "name string, metric string")


@query("SELECT vec_id, 1.0::DOUBLE AS norm, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) + 0 AS first FROM embeddings")
def normalised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", normalised(F.col("embedding")).alias("v"))
    return rows.select("vec_id", F.round(F.sqrt(inner_product(F.col("v"), F.col("v"))), 4).alias("norm"), (F.round(F.col("v")[0], 4) + 0).alias("first"))


# -- readers, generators, filters -------------------------------------------------------------------------------


@query("SELECT kind, vec_id, round(list_sum(CASE WHEN kind IN ('fvecs', 'fbin') THEN embedding::DOUBLE[] ELSE list_transform(embedding::DOUBLE[], lambda x: trunc((x::FLOAT * 1000::FLOAT)::DOUBLE)) END), 3) + 0 AS total, 64::INT AS dim FROM embeddings, (VALUES ('fvecs'), ('ivecs'), ('fbin'), ('ibin')) k(kind)")
def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written in the four formats, and read again in ranges by many tasks."""
    folder = scratch_folder(spark)
    os.makedirs(folder, exist_ok=True)
    x = _vectors(table(spark, sf_dir, "embeddings"))[1].astype(np.float32)
    out = None
    for kind in ("fvecs", "ivecs", "fbin", "ibin"):
        at = os.path.join(folder, f"v.{kind}")
        write_vectors(x if kind[0] == "f" else (x * np.float32(1000)).astype(np.int32), at)
        total = F.aggregate(F.transform("embedding", lambda v: v.cast("double")), F.lit(0.0), lambda s, v: s + v)
        got = read_vectors(spark, at, chunk=100).select(F.lit(kind).alias("kind"), "vec_id", (F.round(total, 3) + 0).alias("total"), F.size("embedding").alias("dim"))
        out = got if out is None else out.unionAll(got)
    return out


@query("SELECT vec_id, label, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS tests, round(embedding[1]::DOUBLE, 4) + 0 AS first FROM embeddings")
def filtered_benchmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors.npy, payloads.jsonl and tests.jsonl of a folder, joined by their line numbers."""
    folder = scratch_folder(spark)
    os.makedirs(folder, exist_ok=True)
    rows = sorted((r.vec_id, r.label, list(r.embedding)) for r in table(spark, sf_dir, "embeddings").collect())
    write_vectors(np.array([r[2] for r in rows], np.float32), os.path.join(folder, "vectors.npy"))
    for name, lines in (("payloads", [{"label": r[1]} for r in rows]), ("tests", [{"query": r[2]} for r in rows if r[0] % 20 == 0])):
        with open(os.path.join(folder, f"{name}.jsonl"), "w") as f:
            f.writelines(json.dumps(x) + "\n" for x in lines)
    vectors, payloads, tests = read_filtered_benchmark(spark, folder)
    both = vectors.join(payloads, "vec_id")
    return both.select("vec_id", F.get_json_object("json", "$.label").cast("int").alias("label"), F.lit(tests.count()).cast("long").alias("tests"), (F.round(F.col("embedding")[0].cast("double"), 4) + 0).alias("first"))


_FNV = "list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(range(8), lambda i: ((p_partkey >> (8 * i)::BIGINT) & 255)::UBIGINT)), lambda h, b: ((xor(h, b)::HUGEINT * 1099511628211) % 18446744073709551616::HUGEINT)::UBIGINT)"
_ZETA = "list_sum(list_transform(range(1, 1001), lambda i: pow(i, -0.5)))"


@query(f"""
    WITH u AS (SELECT p_partkey, (p_partkey % 997) / 997.0 AS u, {_ZETA} AS total, (1 - pow(2.0 / 1000, 0.5)) / (1 - (1 + pow(2, -0.5)) / {_ZETA}) AS eta, {_FNV} AS h FROM part)
    SELECT p_partkey, h::VARCHAR AS fnv, CASE WHEN u * total < 1 THEN 1 WHEN u * total < 1 + pow(0.5, 0.5) THEN 2 ELSE least(1000, 1 + trunc(1000 * pow(greatest(eta * u - eta + 1, 0), 2)))::BIGINT END AS zipf FROM u
""")
def generated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a hashes and Zipf numbers of part keys."""
    rows = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") % 997) / F.lit(997.0)).alias("u"))

    @F.pandas_udf("string")
    def fnv(v):
        import pandas as pd

        return pd.Series(fnv1a(v.to_numpy()).astype(str))

    return rows.select("p_partkey", fnv("p_partkey").alias("fnv"), zipf_column(F.col("u"), 1000, 0.5).alias("zipf"))


@query("SELECT p_partkey FROM part WHERE (p_type = 'ECONOMY' OR p_size >= 45) AND NOT p_brand = 'Brand#2'")
def filter_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"and": [{"or": [{"field": "p_type", "op": "==", "value": "ECONOMY"}, {"field": "p_size", "op": ">=", "value": 45}]}, {"not": {"field": "p_brand", "op": "eq", "value": "Brand#2"}}]}
    return where(table(spark, sf_dir, "part"), parse_legacy(spec)).select("p_partkey")


@query(f"SELECT vec_id FROM ({TAGGED}) WHERE label >= 2 AND label < 6 AND list_contains(tags, 22)")
def filter_match_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of the match/range form; a match on an array looks into it."""
    spec = from_match_range({"and": [{"label": {"range": {"gte": 2, "lt": 6}}}, {"tags": {"match": {"value": 22}}}, {"at": {"geo": {}}}]}, {"tags"})
    return where(tagged(spark, sf_dir), spec).select("vec_id")


@query("SELECT p_partkey, 'eq' AS test FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 'ne' FROM part WHERE NOT p_size > 25 UNION ALL SELECT p_partkey, 'gte strict' FROM part UNION ALL SELECT p_partkey, 'number' FROM part WHERE false")
def filter_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("large", F.col("p_size") > 25)
    out = where(rows, {"large": True}).select("p_partkey", F.lit("eq").alias("test"))
    out = out.unionAll(where(rows, {"large": {"$ne": True}}).select("p_partkey", F.lit("ne")))
    out = out.unionAll(where(rows, {"large": {"$gte": True}}, strict=True).select("p_partkey", F.lit("gte strict")))
    return out.unionAll(where(rows, {"large": 1}).select("p_partkey", F.lit("number")))


@query("""SELECT * FROM (VALUES ('{"a": {"$like": 1}}', 'Unknown filter operator: $like'), ('{"$and": 3}', '$and needs a list'), ('[1]', 'a filter must be a JSON object'), ('{"a": {"$gt": true}}', '$gt has no meaning for a boolean')) t(filter, error)""")
def filter_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    df = spark.createDataFrame([], "a boolean")
    for spec in ('{"a": {"$like": 1}}', '{"$and": 3}', "[1]", '{"a": {"$gt": true}}'):
        try:
            where(df, spec)
        except ValueError as e:
            rows.append((spec, str(e)))
    return spark.createDataFrame(rows, "filter string, error string")


@query("""SELECT * FROM (VALUES ('', 1.0::DOUBLE), ('{"a": 1}', 0.1), ('{"a": {"$ne": 1}}', 0.9), ('{"a": {"$gt": 1}}', 0.3), ('{"a": {"$in": [1]}}', 0.2), ('{"a": {"$nin": [1]}}', 0.8), ('{"a": {"$contains": 1}}', 0.1), ('{"a": 1, "b": {"$lt": 2}}', 0.03), ('{"$or": [{"a": {"$ne": 1}}, {"b": {"$nin": [2]}}]}', 1.0)) t(filter, part)""")
def filter_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = ("", '{"a": 1}', '{"a": {"$ne": 1}}', '{"a": {"$gt": 1}}', '{"a": {"$in": [1]}}', '{"a": {"$nin": [1]}}', '{"a": {"$contains": 1}}', '{"a": 1, "b": {"$lt": 2}}', '{"$or": [{"a": {"$ne": 1}}, {"b": {"$nin": [2]}}]}')
    return spark.createDataFrame([(s, round(selectivity(parse_filter(s)), 6)) for s in specs], "filter string, part double")


# -- catalog and settings -----------------------------------------------------------------------------------------


@query("""SELECT * FROM (VALUES ('graph', 'diskann', 64::BIGINT, 500::BIGINT, '{"L_build": 100, "R_max_degree": 32, "alpha": 1.2, "is_dynamic": true, "metric": "l2", "owner": "me"}', true, 8589934599::BIGINT), ('vectors', 'hnsw', 64, 1000000, '{"M": 16, "ef_construction": 100, "max_elements": 1000000, "metric": "l2"}', true, 4294967303)) t(name, type, dimensions, max_elements, config, valid, page)""")
def catalog_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as a process has it: indices made, one configured, one dropped, and their handles."""
    ws = _workspace(spark)
    IndexCatalog.initialize(ws)
    catalog = IndexCatalog.instance()
    assert IndexCatalog.is_initialized() and catalog.data_dir() == ws.data_dir
    catalog.create_hnsw_index("vectors", 64, config=HNSWConfig())
    catalog.create_diskann_index("graph", 64, 500, DiskANNConfig(R_max_degree=32, is_dynamic=True))
    catalog.create_index("gone", IndexType.TEXT)
    catalog.update_config("graph", owner="me")
    catalog.drop_index("gone")
    assert not catalog.index_exists("gone") and catalog.get_index_info("graph").status == IndexStatus.ACTIVE.value
    handles = [catalog.open_index(i.name) for i in catalog.list_indexes()]
    IndexCatalog.shutdown()
    rows = [(h.name, h.type.value, h.dimensions, h.max_elements, json.dumps(h.info.config, sort_keys=True), h.is_valid, h.global_page_id(7)) for h in handles]
    return spark.createDataFrame(rows, "name string, type string, dimensions long, max_elements long, config string, valid boolean, page long")


@query("SELECT 'WARN,DEBUG,ERROR,OFF,ERROR' AS levels, 'unknown log level: loud' AS error, '2560m' AS memory, 0::BIGINT AS cached, true AS locked, true AS closed_raises, count(*) AS n FROM region")
def workspace_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log levels by name and value, pool settings, eviction of cached tables, the lock of an open folder, and calls on a closed one."""
    ws = _workspace(spark)
    levels = [ws.get_log_level().value]
    for level in ("debug", "Error", LogLevel.OFF, LogLevel.ERROR):
        ws.set_log_level(level)
        levels.append(ws.get_log_level().value)
    try:
        ws.set_log_level("loud")
        error = ""
    except ValueError as e:
        error = str(e)
    rows = table(spark, sf_dir, "region").persist()
    n = rows.count()
    ws.flush_storage()
    ws.force_evict_buffer_portion(0.5)
    cached = int(rows.storageLevel != StorageLevel.NONE)
    try:
        Workspace(spark, ws.data_dir)
        locked = False
    except RuntimeError:
        locked = True
    ws.close()
    try:
        ws.flush_storage()
        closed = False
    except RuntimeError:
        closed = True
    return _one(spark, levels=",".join(levels), error=error, memory=buffer_config(2.5)["spark.executor.memory"], cached=cached, locked=locked, closed_raises=closed, n=n)


@query("SELECT true AS ordered, true AS positive")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    got = evaluate.latency(lambda: rows.filter("label = 3").count(), 3)
    return _one(spark, ordered=got["p50_ms"] <= got["p95_ms"] <= got["p99_ms"], positive=got["qps"] > 0)


# -- ordered indices that change -------------------------------------------------------------------------------------


@query("SELECT p_type, p_size::BIGINT AS p_size, p_partkey AS doc_id, (SELECT count(*) FROM part WHERE p_size <= 5) AS removed, true AS twice_raises FROM part WHERE p_size > 5 AND p_type = 'ECONOMY' AND p_size < 30 UNION ALL SELECT 'ECONOMY', 7, -1, (SELECT count(*) FROM part WHERE p_size <= 5), true")
def metadata_index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertion one by one and in bulk, removal, and a prefix range of what is left."""
    index = MetadataIndex(spark, scratch_folder(spark), {"p_type": "string", "p_size": "long"})
    rows = table(spark, sf_dir, "part").select("p_type", F.col("p_size").cast("long").alias("p_size"), F.col("p_partkey").alias("doc_id"))
    index.insert_batch(rows)
    index.insert([("ECONOMY", 7, -1)])
    try:
        index.insert([("ECONOMY", 7, -1)])
        twice = False
    except ValueError:
        twice = True
    removed = index.remove(rows.filter("p_size <= 5"))
    got = index.index().prefix_range_scan(["ECONOMY"], None, 30, True, False)
    return got.select("*", F.lit(removed).cast("long").alias("removed"), F.lit(twice).alias("twice_raises"))


@query("SELECT doc_id, length(coalesce(text, '')) + CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS length, (SELECT length(coalesce(text, ''))::BIGINT FROM documents WHERE doc_id = 5) + (SELECT CASE WHEN lang = 'de' THEN 1 ELSE 0 END FROM documents WHERE doc_id = 5) AS of_five, false AS has_six, true AS unknown_raises FROM documents WHERE doc_id <> 6")
def doc_id_index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and lengths of documents: inserted, some updated, one removed, and written anew."""
    index = DocIdIndex(spark, scratch_folder(spark))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("slot"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("length"), "lang")
    index.insert(rows)
    index.update(rows.filter("lang = 'de'").withColumn("length", F.col("length") + 1))
    index.remove([(6,)])
    try:
        index.update([(10**12, 0, 0, 0)])
        unknown = False
    except KeyError:
        unknown = True
    index.compact()
    return index.live().select("doc_id", "length", F.lit(index.get_doc_length(5)).cast("long").alias("of_five"), F.lit(index.contains(6)).alias("has_six"), F.lit(unknown).alias("unknown_raises"))


@query("SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS n, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_custkey = 7) AS of_seven FROM orders WHERE o_orderstatus <> 'P'")
def row_store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by composite key: rows inserted, updated in place by a condition, erased, counted whole and by a prefix, and scanned downwards."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    store = LogTable(spark, scratch_folder(spark), rows.schema, ["o_custkey", "o_orderkey"])
    store.put(rows)
    store.update_where(F.col("o_orderstatus") == "O", o_totalprice=F.col("o_totalprice") * 2)
    store.remove(rows.filter("o_orderstatus = 'P'"))
    of_seven = store.ordered().prefix_lookup(7).count()
    return store.ordered().scan(descending=True).select("o_custkey", "o_orderkey", "o_totalprice", F.lit(store.count()).cast("long").alias("n"), F.lit(of_seven).cast("long").alias("of_seven"))


# -- order entry ----------------------------------------------------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines again as requests; each thousandth asks for an item that isn't there."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    lines = dealt(lines, "l_orderkey", like=lines).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    item = F.when(F.col("l_orderkey") % 1000 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    return lines.select(F.col("o_custkey").alias("customer"), F.col("l_orderkey").alias("request"), item.alias("item"), F.col("l_quantity").alias("quantity"))


_GOOD = "SELECT o_custkey AS customer, l_orderkey AS request, l_partkey AS item, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 1000 <> 0"


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    stock = part.select(F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("in_stock"))
    prices = part.select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("price"))
    return oltp.new_orders(_requests(spark, sf_dir), stock, prices, first_order=10_000_000)


@query(f"WITH g AS ({_GOOD}) SELECT request + 10000000 AS \"order\", min(customer) AS customer, DATE '1998-08-03' AS day, 'O' AS status, count(*) AS n_lines FROM g GROUP BY request")
def new_order_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)[0]


@query(f"WITH g AS ({_GOOD}) SELECT request + 10000000 AS \"order\", row_number() OVER (PARTITION BY request ORDER BY item, quantity)::INT AS line, item, quantity, round(quantity * p_retailprice, 2) AS amount FROM g JOIN part ON p_partkey = item")
def new_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)[1].withColumn("amount", F.round("amount", 2))


@query(f"WITH g AS ({_GOOD}), s AS (SELECT p_partkey AS item, p_size - coalesce(sold, 0) AS q FROM part LEFT JOIN (SELECT item AS i, sum(quantity) AS sold FROM g GROUP BY 1) ON i = p_partkey) SELECT item, q + CASE WHEN q < 10 THEN ceil((10 - q) / 91) * 91 ELSE 0 END AS in_stock FROM s")
def new_order_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)[2]


def _delivered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("district"), F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_extendedprice").alias("amount"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("balance"))
    return oltp.deliver(orders, lines, customers)


_OLDEST = "SELECT o_orderpriority, min(o_orderkey) AS o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1"


@query(f"WITH m AS ({_OLDEST}) SELECT o_orderpriority AS district, o_orderkey AS \"order\", o_custkey AS customer, CASE WHEN o_orderkey IN (SELECT o FROM m) THEN 'F' ELSE o_orderstatus END AS status FROM orders")
def delivery_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delivered(spark, sf_dir)[0]


@query(f"WITH m AS ({_OLDEST}), d AS (SELECT o_custkey, sum(l_extendedprice) AS due FROM m JOIN orders ON o_orderkey = o JOIN lineitem ON l_orderkey = o GROUP BY 1) SELECT c_custkey AS customer, round(c_acctbal + coalesce(due, 0), 2) AS balance FROM customer LEFT JOIN d ON o_custkey = c_custkey")
def delivery_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delivered(spark, sf_dir)[1].withColumn("balance", F.round("balance", 2))


@query("SELECT CASE WHEN d < 43 THEN 'payment' WHEN d < 47 THEN 'order_status' WHEN d < 51 THEN 'delivery' WHEN d < 55 THEN 'stock_level' ELSE 'new_order' END AS transaction, count(*) AS n FROM (SELECT event_id * 37 % 100 AS d FROM events) GROUP BY 1")
def transaction_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = table(spark, sf_dir, "events").select((F.col("event_id") * 37 % 100).alias("draw"))
    return oltp.transaction_mix(draws).groupBy("transaction").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS nodes, true AS linked FROM embeddings")
def graph_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer 0 of graphs in several parts holds every vector, with links."""
    got = graph.layer_stats(graph.build(table(spark, sf_dir, "embeddings"), "hnsw", part=300, m=8, ef=24)).filter("layer = 0").first()
    return _one(spark, nodes=got.nodes, linked=got.avg_neighbors >= 4)
