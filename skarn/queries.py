"""The registered queries of the engine, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.catalog import IndexCatalog
from skarn.collection import Collection
from skarn.functions.distance import cosine_distance, distance
from skarn.functions.text import Analyzer, snippet, tokens
from skarn.operators import graph, hybrid, ivfpq
from skarn.operators.filters import where
from skarn.operators.knn import centroids, knn, knn_join, medoids, with_tag, within, without
from skarn.operators.ordered import OrderedIndex, bitmap, bitmap_count, id_difference, id_intersection, id_union, latest
from skarn.operators.text import TextIndex
from skarn.plans import evaluate, oltp
from skarn.plans.layout import scratch_folder, spread
from skarn.schema import Schema
from skarn.session import Workspace
from skarn.sources.documents import chunk_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").first().embedding)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names})


# -- vectors -------------------------------------------------------------------------------------------

V = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
DIST = {
    "l2": "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "ip": "1 - list_inner_product({a}, {b})",
    "cosine": "1 - list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b}))",
}


def sql_distance(metric: str, a: str, b: str) -> str:
    return DIST[metric].format(a=a, b=b)


def _knn(metric: str, filter: str | None = None, cond: str = "true") -> tuple[Callable, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = knn(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10, metric, filter=filter)
        return rounded(got.select("rank", "vec_id", "label", "distance"), "distance")

    d = sql_distance(metric, "embedding::DOUBLE[]", V)
    sql = f"""
        WITH d AS (SELECT vec_id, label, {d} AS distance FROM embeddings WHERE {cond}),
             r AS (SELECT row_number() OVER (ORDER BY distance, vec_id)::INT AS rank, * FROM d)
        SELECT rank, vec_id, label, round(distance, 4) AS distance FROM r WHERE rank <= 10
    """
    return run, sql


for _name, _args in {
    "knn_l2": ("l2",),
    "knn_ip": ("ip",),
    "knn_cosine": ("cosine",),
    "knn_cosine_filtered": ("cosine", '{"label": {"$in": [1, 2, 3]}}', "label IN (1, 2, 3)"),
    "knn_l2_filtered_and": ("l2", '{"$and": [{"label": {"$gte": 2}}, {"label": {"$lt": 8}}, {"label": {"$ne": 5}}]}', "label >= 2 AND label < 8 AND label <> 5"),
}.items():
    _run, _sql = _knn(*_args)
    query(_sql, _name)(_run)


def _join_sql(metric: str, k: int, cond: str = "true") -> str:
    return f"""
        WITH d AS (SELECT q.vec_id AS qid, v.vec_id AS id, {sql_distance(metric, "v.embedding::DOUBLE[]", "q.embedding::DOUBLE[]")} AS distance
                   FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND {cond}),
             r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 12), id)::INT AS rank, id, distance FROM d)
        SELECT qid, rank, id, round(distance, 4) + 0 AS distance FROM r WHERE rank <= {k}
    """


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of batch searches: every vector whose id 20 divides, against all."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0")


@query(_join_sql("l2", 10))
def knn_join_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn_join(query_set(spark, sf_dir), table(spark, sf_dir, "embeddings"), 10, "l2"), "distance")


@query(_join_sql("cosine", 10))
def knn_join_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn_join(query_set(spark, sf_dir), table(spark, sf_dir, "embeddings"), 10, "cosine"), "distance")


@query(_join_sql("ip", 5, "v.label = 4"))
def knn_join_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = where(table(spark, sf_dir, "embeddings"), {"label": 4})
    return rounded(knn_join(query_set(spark, sf_dir), rows, 5, "ip"), "distance")


@query(
    f"""
    WITH v AS (SELECT * FROM embeddings WHERE label = 3),
         d AS (SELECT q.vec_id AS qid, v.vec_id AS id, {sql_distance("l2", "v.embedding::DOUBLE[]", "q.embedding::DOUBLE[]")} AS distance FROM embeddings q, v WHERE q.vec_id % 20 = 0),
         r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 12), id)::INT AS rank, id, distance FROM d),
         p AS (SELECT vec_id AS qid, unnest(range(1, 101))::INT AS rank FROM embeddings WHERE vec_id % 20 = 0)
    SELECT p.qid, p.rank, coalesce(r.id, -1) AS id, coalesce(round(r.distance, 4), 'inf'::DOUBLE) AS distance FROM p LEFT JOIN r USING (qid, rank)
    """
)
def knn_join_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = where(table(spark, sf_dir, "embeddings"), {"label": 3})
    return rounded(knn_join(query_set(spark, sf_dir), rows, 100, "l2", padded=True), "distance")


TAGGED = "SELECT *, [label, label + 10, vec_id % 7 + 20] AS tags FROM embeddings"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("tags", F.array(F.col("label").cast("long"), F.col("label") + 10, F.col("vec_id") % 7 + 20))


@query(
    f"""
    WITH d AS (SELECT vec_id, {sql_distance("l2", "embedding::DOUBLE[]", V)} AS distance FROM ({TAGGED}) WHERE list_contains(tags, 22)),
         r AS (SELECT row_number() OVER (ORDER BY distance, vec_id)::INT AS rank, * FROM d)
    SELECT rank, vec_id, round(distance, 4) AS distance FROM r WHERE rank <= 15
    """
)
def knn_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = knn(with_tag(tagged(spark, sf_dir), 22), first_vector(spark, sf_dir), 15, "l2")
    return rounded(got.select("rank", "vec_id", "distance"), "distance")


@query(
    f"""
    WITH d AS (SELECT vec_id, {sql_distance("l2", "embedding::DOUBLE[]", V)} AS distance FROM embeddings WHERE label <> 7),
         r AS (SELECT row_number() OVER (ORDER BY distance, vec_id)::INT AS rank, * FROM d)
    SELECT rank, vec_id, round(distance, 4) AS distance FROM r WHERE rank <= 15
    """
)
def knn_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    got = knn(without(rows, rows.filter("label = 7")), first_vector(spark, sf_dir), 15, "l2")
    return rounded(got.select("rank", "vec_id", "distance"), "distance")


@query(f"SELECT vec_id, round(distance, 4) AS distance FROM (SELECT vec_id, {sql_distance('cosine', 'embedding::DOUBLE[]', V)} AS distance FROM embeddings) WHERE distance <= 0.9")
def within_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(within(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 0.9).select("vec_id", "distance"), "distance")


@query(
    """
    SELECT label AS "group", p AS position, round(avg(embedding[p + 1]::DOUBLE), 4) AS mean
    FROM embeddings, range(64) t(p) GROUP BY ALL
    """
)
def centroid_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = centroids(table(spark, sf_dir, "embeddings"), "label")
    return rounded(got.select("group", F.posexplode("centroid").alias("p", "mean")).select("group", F.col("p").cast("long").alias("position"), "mean"), "mean")


@query(
    f"""
    WITH m AS (SELECT label, p, avg(embedding[p + 1]::DOUBLE) AS x FROM embeddings, range(64) t(p) GROUP BY ALL),
         c AS (SELECT label, list(x ORDER BY p) AS centroid FROM m GROUP BY label),
         d AS (SELECT e.label, vec_id, {sql_distance("l2", "embedding::DOUBLE[]", "centroid")} AS d FROM embeddings e JOIN c USING (label))
    SELECT label, arg_min(vec_id, (d, vec_id)) AS medoid FROM d GROUP BY label
    """
)
def medoid_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medoids(table(spark, sf_dir, "embeddings"), "label")


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm, round(list_inner_product(embedding[17:32]::DOUBLE[], embedding[17:32]::DOUBLE[]), 4) AS part FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.functions.distance import inner_product, sub_vector

    part = sub_vector(F.col("embedding"), 1, 16)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.sqrt(inner_product(F.col("embedding"), F.col("embedding"))).alias("norm"), inner_product(part, part).alias("part"))
    return rounded(rows, "norm", "part")


@query(
    f"""
    WITH c AS (SELECT vec_id AS cluster_id, embedding::DOUBLE[] AS centroid FROM embeddings WHERE vec_id < 8),
         d AS (SELECT e.vec_id AS id, cluster_id, {sql_distance("l2", "e.embedding::DOUBLE[]", "centroid")} AS d FROM embeddings e, c)
    SELECT id, arg_min(cluster_id, (round(d, 12), cluster_id)) AS cluster_id, round(min(d), 4) + 0 AS distance FROM d GROUP BY id
    """
)
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors to the nearest of eight given centroids."""
    rows = table(spark, sf_dir, "embeddings")
    given = rows.filter("vec_id < 8").select(F.col("vec_id").alias("cluster_id"), F.col("embedding").alias("centroid"))
    return rounded(ivfpq.assign(rows, given), "distance")


#: Of 16 lists. Fewer lose too many neighbours of the generated vectors (ivfpq_recall).
NPROBE = 12


@query()
def ivfpq_train_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = ivfpq.train(rows, 16, 8)
    return ivfpq.search(ivfpq.encode(rows, model), model, query_set(spark, sf_dir), 10, NPROBE, vectors=rows)


@query()
def ivf_list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ivfpq.list_sizes(ivfpq.encode(rows, ivfpq.train(rows, 16, 8)), 16)


@query()
def ivfpq_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the approximate search for several nprobe, against the exact one."""
    rows, queries = table(spark, sf_dir, "embeddings"), query_set(spark, sf_dir)
    model = ivfpq.train(rows, 16, 8)
    codes, truth = ivfpq.encode(rows, model), knn_join(queries, rows, 10, "l2")
    out = None
    for nprobe in (1, 4, NPROBE, 16):
        got = evaluate.recall(ivfpq.search(codes, model, queries, 10, nprobe, vectors=rows), truth, 10)
        got = got.agg(F.lit(nprobe).alias("nprobe"), F.avg("recall").alias("recall"))
        out = got if out is None else out.unionAll(got)
    return out


@query(
    f"""
    WITH d AS (SELECT q.vec_id AS qid, v.vec_id AS id, v.label, {sql_distance("l2", "v.embedding::DOUBLE[]", "q.embedding::DOUBLE[]")} AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
         t AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 12), id) AS r FROM d),
         f AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 12), id) AS r FROM d WHERE label <= 5)
    SELECT t.qid, round(count(f.id) / 10.0, 4) AS recall FROM t LEFT JOIN f ON t.qid = f.qid AND t.id = f.id AND f.r <= 10 WHERE t.r <= 10 GROUP BY t.qid
    """
)
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of a search over the labels up to 5, against the truth over all."""
    rows, queries = table(spark, sf_dir, "embeddings"), query_set(spark, sf_dir)
    return rounded(evaluate.recall(knn_join(queries, where(rows, {"label": {"$lte": 5}}), 10, "l2"), knn_join(queries, rows, 10, "l2"), 10), "recall")


@query()
def hnsw_graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean recall of the layered graphs, one for each part of the vectors."""
    rows, queries = table(spark, sf_dir, "embeddings"), query_set(spark, sf_dir)
    pairs = [(r.vec_id, list(r.embedding)) for r in queries.select("vec_id", "embedding").collect()]
    found = graph.search(graph.build(rows, "hnsw", part=1000, m=12, ef=48), pairs, 10, 64)
    return evaluate.recall(found, knn_join(queries, rows, 10, "l2"), 10).agg(F.avg("recall").alias("recall"))


@query()
def vamana_tag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole query set, among the vectors with a tag."""
    rows = tagged(spark, sf_dir)
    pairs = [(r.vec_id, list(r.embedding)) for r in query_set(spark, sf_dir).select("vec_id", "embedding").collect()]
    graphs = graph.build(rows, "vamana", tags_col="tags", part=1000, degree=16, width=32)
    return graph.search(graphs, pairs, 10, 64, label=22)


# -- filters -------------------------------------------------------------------------------------------

FILTERS: dict[str, tuple[str, str, str | dict, str, bool]] = {
    "filter_eq": ("events", "event_id", '{"event_type": "click"}', "event_type = 'click'", False),
    "filter_eq_int": ("events", "event_id", {"user_id": {"$eq": 7}}, "user_id = 7", False),
    "filter_ne": ("events", "event_id", {"event_type": {"$ne": "click"}}, "event_type <> 'click'", False),
    "filter_ne_other_type": ("events", "event_id", {"event_type": {"$ne": 5}}, "event_type IS NOT NULL", False),
    "filter_gt": ("events", "event_id", {"value": {"$gt": 100}}, "value > 100", False),
    "filter_gte": ("orders", "o_orderkey", {"o_totalprice": {"$gte": 250000.5}}, "o_totalprice >= 250000.5", False),
    "filter_lt": ("part", "p_partkey", {"p_size": {"$lt": 10}}, "p_size < 10", False),
    "filter_lte": ("part", "p_partkey", {"p_size": {"$lte": 10}}, "p_size <= 10", False),
    "filter_range": ("part", "p_partkey", {"p_size": {"$gte": 10, "$lte": 20}}, "p_size BETWEEN 10 AND 20", False),
    "filter_range_strict": ("part", "p_partkey", {"p_size": {"$gte": 10, "$lte": 20}}, "p_size >= 10", True),
    "filter_in": ("orders", "o_orderkey", {"o_orderstatus": {"$in": ["F", "P"]}}, "o_orderstatus IN ('F', 'P')", False),
    "filter_in_int": ("part", "p_partkey", {"p_size": {"$in": [1, 5, 9]}}, "p_size IN (1, 5, 9)", False),
    "filter_nin": ("orders", "o_orderkey", {"o_orderstatus": {"$nin": ["F", "P"]}}, "o_orderstatus NOT IN ('F', 'P')", False),
    "filter_and_or_nested": ("part", "p_partkey", {"$and": [{"p_type": "ECONOMY"}, {"$or": [{"p_size": {"$lt": 5}}, {"p_size": {"$gt": 45}}]}]}, "p_type = 'ECONOMY' AND (p_size < 5 OR p_size > 45)", False),
    "filter_string_range": ("part", "p_partkey", {"p_brand": {"$gte": "Brand#2"}}, "p_brand >= 'Brand#2'", False),
    "filter_multi_key": ("part", "p_partkey", {"p_type": "ECONOMY", "p_size": {"$gt": 40}}, "p_type = 'ECONOMY' AND p_size > 40", False),
    "filter_multi_key_strict": ("part", "p_partkey", {"p_type": "ECONOMY", "p_size": {"$gt": 40}}, "p_size > 40", True),
    "filter_int_vs_float": ("part", "p_partkey", {"p_retailprice": 900}, "p_retailprice = 900", False),
    "filter_int_vs_float_strict": ("part", "p_partkey", {"p_retailprice": 900}, "trunc(p_retailprice) = 900", True),
    "filter_empty": ("part", "p_partkey", {}, "false", False),
    "filter_none": ("part", "p_partkey", "", "true", False),
    "filter_empty_or": ("part", "p_partkey", {"$or": []}, "false", False),
    "filter_json_key": ("events", "event_id", {"k": {"$gte": 90}}, "CAST(json_extract_string(props, '$.k') AS INT) >= 90", False),
    "filter_json_nin": ("events", "event_id", {"k": {"$nin": [1, 2, 3]}}, "CAST(json_extract_string(props, '$.k') AS INT) NOT IN (1, 2, 3)", False),
    "filter_json_missing": ("events", "event_id", {"absent": {"$ne": 1}}, "false", False),
}


def _filter(name: str, ident: str, spec: str | dict, strict: bool) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return where(table(spark, sf_dir, name), spec, "props" if name == "events" else None, strict).select(ident)

    return run


for _name, (_table, _ident, _spec, _cond, _strict) in FILTERS.items():
    query(f"SELECT {_ident} FROM {_table} WHERE {_cond}", _name)(_filter(_table, _ident, _spec, _strict))


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality <> 1")
def filter_missing_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label lack the key, so $ne doesn't match them."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return where(docs, {"quality": {"$ne": 1}}).select("doc_id", "quality")


@query(f"SELECT vec_id FROM ({TAGGED}) WHERE list_contains(tags, 12)")
def filter_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return where(tagged(spark, sf_dir), {"tags": {"$contains": 12}}).select("vec_id")


# -- ordered lookups and id sets ---------------------------------------------------------------------------

PART = "SELECT p_partkey, p_brand, p_type, p_size FROM part"


def _parts(spark: SparkSession, sf_dir: str) -> OrderedIndex:
    return OrderedIndex(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size"), ["p_brand", "p_type", "p_size"], "p_partkey")


@query(f"{PART} WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY' AND p_size = 11")
def meta_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).lookup("Brand#2", "ECONOMY", 11)


@query(f"{PART} WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY'")
def meta_prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).prefix_lookup("Brand#2", "ECONOMY")


@query(f"{PART} WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY' AND p_size >= 10 AND p_size < 30")
def meta_prefix_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).prefix_range_scan(["Brand#2", "ECONOMY"], 10, 30, True, False)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 150000")
def meta_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OrderedIndex(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "o_orderkey").range_scan(100000.0, 150000.0, False, True)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def meta_less_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OrderedIndex(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "c_custkey").less_than(0.0)


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1 GROUP BY o_custkey")
def latest_by_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


def _id_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    return docs.filter("lang = 'en'"), docs.filter("n_chars > 2000")


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM documents WHERE n_chars > 2000")
def ids_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_union(*_id_sets(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM documents WHERE n_chars > 2000")
def ids_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_intersection(*_id_sets(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM documents WHERE n_chars > 2000")
def ids_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_difference(*_id_sets(spark, sf_dir))


@query("SELECT count(DISTINCT doc_id) AS n FROM documents WHERE lang = 'en'")
def ids_bitmap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmap_count(bitmap(_id_sets(spark, sf_dir)[0]))


# -- text ------------------------------------------------------------------------------------------------

STOP = "['" + "','".join("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()) + "']"
TERMS = f"list_filter(string_split_regex(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) >= 2 AND NOT list_contains({STOP}, t))"
INDEX = f"""
    toks AS (SELECT doc_id, lang, {TERMS} AS terms FROM documents),
    post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM toks) GROUP BY ALL),
    dl AS (SELECT doc_id, len(terms) AS doc_len FROM toks WHERE len(terms) > 0),
    st AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM dl),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


def _terms_sql(text: str) -> str:
    return TERMS.replace("coalesce(text, '')", text)


@query(f"SELECT doc_id, len(terms)::INT AS n_terms, len(list_distinct(terms))::INT AS n_distinct, md5(array_to_string(terms, ' ')) AS digest FROM (SELECT doc_id, {TERMS} AS terms FROM documents)")
def tokenize_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("terms"))
    return rows.select("doc_id", F.size("terms").alias("n_terms"), F.size(F.array_distinct("terms")).alias("n_distinct"), F.md5(F.array_join("terms", " ").cast("binary")).alias("digest"))


def _plain_sql(split: str) -> str:
    terms = f"list_filter(list_transform({split}, lambda t: lower(regexp_replace(t, '[^A-Za-z0-9]', '', 'g'))), lambda t: length(t) >= 2)"
    return f"SELECT doc_id, len(terms)::INT AS n_terms, md5(array_to_string(terms, ' ')) AS digest FROM (SELECT doc_id, {terms} AS terms FROM documents)"


def _plain(analyzer: Analyzer) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text"), analyzer).alias("terms"))
        return rows.select("doc_id", F.size("terms").alias("n_terms"), F.md5(F.array_join("terms", " ").cast("binary")).alias("digest"))

    return run


query(_plain_sql(r"string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+')"), "tokenize_whitespace")(_plain(Analyzer.WHITESPACE))
query(_plain_sql("[coalesce(text, '')]"), "tokenize_none")(_plain(Analyzer.NONE))


_indices: dict[tuple[str, str], TextIndex] = {}


def _index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The text index of all documents: written at a session's first use, and read by all its queries."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _indices:
        path = f"{scratch_folder(spark)}/text"
        TextIndex.build(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").write(path)
        _indices[at] = TextIndex.read(spark, path)
    return _indices[at]


@query(f"WITH {INDEX} SELECT (SELECT count(*) FROM df) AS vocab_size, n AS doc_count, (SELECT sum(doc_len) FROM dl)::BIGINT AS total_doc_length, round(avgdl, 4) AS avg_doc_len FROM st")
def text_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_index(spark, sf_dir).stats(), "avg_doc_len")


@query(f"WITH {INDEX} SELECT term, df FROM df")
def postings_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).document_frequencies()


def _bm25_sql(text: str, k: int = 10, cond: str = "true") -> str:
    return f"""
        WITH {INDEX},
             q AS (SELECT unnest({_terms_sql(f"'{text}'")}) AS term),
             w AS (SELECT term, count(*) AS times FROM q GROUP BY term),
             s AS (SELECT doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl))), 10) AS score
                   FROM post JOIN w USING (term) JOIN df USING (term) JOIN dl USING (doc_id) JOIN toks USING (doc_id), st WHERE {cond} GROUP BY doc_id),
             r AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s)
        SELECT rank, doc_id, round(score, 4) AS score FROM r WHERE rank <= {k}
    """


def _bm25(text: str, lang: str | None = None) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = table(spark, sf_dir, "documents").filter(F.col("lang") == lang) if lang else None
        return rounded(_index(spark, sf_dir).search(text, 10, ids), "score")

    return run


query(_bm25_sql("license"), "bm25_single")(_bm25("license"))
query(_bm25_sql("Apache license, version the eine tion"), "bm25_multi")(_bm25("Apache license, version the eine tion"))
query(_bm25_sql("erst erst thing"), "bm25_dup_terms")(_bm25("erst erst thing"))
query(_bm25_sql("ment que tion", cond="lang = 'fr'"), "bm25_filtered_lang")(_bm25("ment que tion", "fr"))


@query(
    f"""
    WITH {INDEX},
         q AS (SELECT item_id AS qid, unnest({_terms_sql("coalesce(text, '')")}) AS term FROM benchmark),
         w AS (SELECT qid, term, count(*) AS times FROM q GROUP BY ALL),
         s AS (SELECT qid, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl))), 10) AS score
               FROM post JOIN w USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY qid, doc_id),
         r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s)
    SELECT qid, rank, doc_id, round(score, 4) AS score FROM r WHERE rank <= 5
    """
)
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts as queries in one job."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return rounded(_index(spark, sf_dir).search_batch(queries, 5), "score")


# -- hybrid ----------------------------------------------------------------------------------------------

HYBRID_TEXT = "erst thing version"
HYBRID = f"""
    {INDEX},
    w AS (SELECT term, count(*) AS times FROM (SELECT unnest({_terms_sql(f"'{HYBRID_TEXT}'")}) AS term) GROUP BY term),
    ts AS (SELECT doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl))), 10) AS score
           FROM post JOIN w USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY doc_id),
    t AS (SELECT * FROM (SELECT doc_id, score AS text_score, row_number() OVER (ORDER BY score DESC, doc_id) AS tr FROM ts) WHERE tr <= 20),
    vs AS (SELECT vec_id AS doc_id, {sql_distance("cosine", "embedding::DOUBLE[]", V)} AS distance FROM embeddings),
    v AS (SELECT * FROM (SELECT doc_id, distance AS vector_score, row_number() OVER (ORDER BY distance, doc_id) AS vr FROM vs) WHERE vr <= 20),
    tn AS (SELECT *, CASE WHEN max(text_score) OVER () - min(text_score) OVER () < 1e-9 THEN 0.5 ELSE (text_score - min(text_score) OVER ()) / (max(text_score) OVER () - min(text_score) OVER ()) END AS tnorm FROM t),
    vn AS (SELECT *, CASE WHEN max(vector_score) OVER () - min(vector_score) OVER () < 1e-9 THEN 0.5 ELSE (vector_score - min(vector_score) OVER ()) / (max(vector_score) OVER () - min(vector_score) OVER ()) END AS vnorm FROM v)"""


def _hybrid_sql(score: str) -> str:
    return f"""
        WITH {HYBRID},
             b AS (SELECT doc_id, {score} AS score, coalesce(vector_score, 0) AS vector_score, coalesce(text_score, 0) AS text_score FROM tn FULL OUTER JOIN vn USING (doc_id)),
             r AS (SELECT row_number() OVER (ORDER BY round(score, 10) DESC, doc_id)::INT AS rank, * FROM b)
        SELECT rank, doc_id, round(score, 4) AS score, round(vector_score, 4) AS vector_score, round(text_score, 4) AS text_score FROM r WHERE rank <= 10
    """


def _hybrid(params: hybrid.FusionParams) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
        vector = knn(rows, first_vector(spark, sf_dir), 20, "cosine", id_col="doc_id").select("doc_id", "distance")
        got = hybrid.fuse(vector, _index(spark, sf_dir).search(HYBRID_TEXT, 20), 10, params)
        return rounded(got, "score", "vector_score", "text_score")

    return run


query(_hybrid_sql("coalesce(1.0 / (60 + vr), 0) + coalesce(1.0 / (60 + tr), 0)"), "hybrid_rrf")(_hybrid(hybrid.FusionParams()))
_W = {"method": hybrid.FusionMethod.WEIGHTED, "vector_weight": 3.0, "text_weight": 1.0}
query(_hybrid_sql("coalesce(1 - vnorm, 0) * 0.75 + coalesce(tnorm, 0) * 0.25"), "hybrid_weighted")(_hybrid(hybrid.FusionParams(**_W)))
query(_hybrid_sql("coalesce(vnorm, 0) * 0.75 + coalesce(tnorm, 0) * 0.25"), "hybrid_weighted_strict")(_hybrid(hybrid.FusionParams(**_W, strict=True)))
query(_hybrid_sql("coalesce(vector_score, 0) * 0.75 + coalesce(text_score, 0) * 0.25"), "hybrid_weighted_raw")(_hybrid(hybrid.FusionParams(**_W, normalize=False)))

NOW = 1_706_745_600.0  # 2024-02-01


@query(
    f"""
    WITH s AS (SELECT event_id, value / 500 AS score, epoch(ts) AS t FROM events),
         f AS (SELECT event_id, 0.7 * score + 0.3 * exp(-(({NOW} - t) / 3600) / 24) AS final_score FROM s)
    SELECT event_id, round(final_score, 4) AS final_score FROM f ORDER BY f.final_score DESC, event_id LIMIT 20
    """
)
def rerank_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 500).alias("score"), F.col("ts").cast("timestamp").cast("double").alias("timestamp"))
    return rounded(hybrid.rerank_recency(rows, 20, 0.3, NOW, id_col="event_id").select("event_id", "final_score"), "final_score")


@query(
    f"""
    WITH s AS (SELECT vec_id, 1 - ({sql_distance("cosine", "embedding::DOUBLE[]", V)}) AS score, label / 10.0 AS popularity FROM embeddings),
         f AS (SELECT vec_id, 0.8 * score + 0.2 * popularity AS final_score FROM s)
    SELECT vec_id, round(final_score, 4) AS final_score FROM f ORDER BY f.final_score DESC, vec_id LIMIT 20
    """
)
def rerank_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cosine_distance(F.col("embedding"), first_vector(spark, sf_dir))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (1 - d).alias("score"), (F.col("label") / 10.0).alias("popularity"))
    return rounded(hybrid.rerank_popularity(rows, 20, 0.2, id_col="vec_id").select("vec_id", "final_score"), "final_score")


@query(
    f"""
    WITH s AS (SELECT vec_id, {sql_distance("l2", "embedding::DOUBLE[]", V)} AS distance FROM embeddings),
         r AS (SELECT vec_id, row_number() OVER (ORDER BY distance, vec_id)::INT AS rank FROM s)
    SELECT rank, vec_id FROM r WHERE rank <= 20 AND vec_id NOT IN (0, 10, 20) ORDER BY rank LIMIT 10
    """
)
def exclude_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 20, "l2")
    return hybrid.excluding(found, [0, 10, 20], 10, "vec_id").select("rank", "vec_id")


WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')"


@query(
    f"""
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id)::INT AS rank, len({WORDS}) AS n_words, sum(len({WORDS})) OVER (ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents WHERE len({WORDS}) > 0)
    SELECT rank, doc_id, n_words::INT AS n_words, total::BIGINT AS total_words FROM r WHERE total <= 2000
    """
)
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as a list ranked from the shortest on, of which the first 2,000 with a word can fill the context."""
    rows = table(spark, sf_dir, "documents").filter(F.coalesce("text", F.lit("")).rlike(r"\S")).orderBy("n_chars", "doc_id").limit(2000)
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy("n_chars", "doc_id"))).withColumnRenamed("text", "content")
    return hybrid.pack_context(ranked, 2000).select("rank", "doc_id", "n_words", "total_words")


@query(
    f"""
    WITH w AS (SELECT item_id, coalesce(text, '') AS content, {WORDS} AS words FROM benchmark),
         h AS (SELECT *, list_transform(words, lambda x: CASE WHEN list_contains(['erst', 'thing', 'que'], trim(lower(x), '.,!?')) THEN 1 ELSE 0 END) AS hits FROM w),
         s AS (SELECT *, list_transform(range(0, len(words)), lambda i: list_sum(hits[i + 1:i + 30])) AS sums FROM h),
         p AS (SELECT *, list_position(sums, list_max(sums)) - 1 AS p FROM s)
    SELECT item_id, CASE WHEN len(words) <= 30 THEN content ELSE CASE WHEN p > 0 THEN '...' ELSE '' END || array_to_string(words[p + 1:p + 30], ' ') || CASE WHEN p + 30 < len(words) THEN '...' ELSE '' END END AS snippet FROM p
    """
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", snippet(F.coalesce("text", F.lit("")), ["erst", "thing", "que"]).alias("snippet"))


# -- documents ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 50 OFFSET 10")
def get_where_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return where(table(spark, sf_dir, "documents"), {"lang": "de"}).orderBy("doc_id").offset(10).limit(50).select("doc_id", "n_chars")


@query("SELECT i.pos, i.doc_id, coalesce(d.lang, '') AS lang FROM (VALUES (0, 5), (1, 3), (2, 999999999), (3, 5)) i(pos, doc_id) LEFT JOIN documents d ON d.doc_id = i.doc_id")
def get_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = spark.createDataFrame(list(enumerate([5, 3, 999_999_999, 5])), "pos int, doc_id int")
    return want.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "left").select("pos", "doc_id", F.coalesce("lang", F.lit("")).alias("lang"))


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 'junk' ELSE lang END AS lang, n_chars FROM documents LEFT JOIN labels USING (doc_id)")
def update_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch of one key for the documents that labels call bad; other keys stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    patch = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", F.lit("junk").alias("_lang"))
    return docs.join(patch, "doc_id", "left").select("doc_id", F.coalesce("_lang", "lang").alias("lang"), "n_chars")


@query("SELECT count(*) FILTER (WHERE lang = 'fr' AND n_chars < 500) AS deleted, count(*) FILTER (WHERE NOT (lang = 'fr' AND n_chars < 500)) AS left_over FROM documents")
def delete_where_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    gone = where(docs, {"lang": "fr", "n_chars": {"$lt": 500}})
    kept = docs.join(gone.select("doc_id"), "doc_id", "left_anti")
    return gone.agg(F.count(F.lit(1)).alias("deleted")).crossJoin(kept.agg(F.count(F.lit(1)).alias("left_over")))


@query(
    r"""
    WITH p AS (SELECT doc_id, unnest(range(0, length(text), 400)) AS s, text FROM documents WHERE length(text) > 0),
         c AS (SELECT doc_id, s, regexp_replace(substr(text, s + 1, 500), '^\s+|\s+$', '', 'g') AS chunk FROM p)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS chunk_no, chunk FROM c WHERE chunk <> ''
    """
)
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(table(spark, sf_dir, "documents"), 500, 100)


@query(
    """
    SELECT * FROM (VALUES (1::BIGINT, 'vectors', 'hnsw', 'active', 64::INT, 1000000::BIGINT, '{"M": 16, "ef_construction": 100, "max_elements": 1000000, "metric": "l2"}', NULL::VARCHAR),
                          (3, 'text', 'text', 'active', 0, 1000000, '{"analyzer": "standard", "b": 0.75, "k1": 1.2, "metric": "l2"}', NULL),
                          (4, 'by_lang', 'btree', 'active', 0, 1000000, '{"fields": ["lang", "n_chars"], "metric": "l2", "unique": false}', NULL)) t(index_id, name, type, status, dimensions, max_elements, config, collection)
    """
)
def catalog_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Workspace(spark, scratch_folder(spark), True) as ws:
        catalog = IndexCatalog(ws)
        catalog.create_hnsw_index("vectors", 64)
        catalog.create_diskann_index("graph", 64)
        catalog.create_text_index("text")
        catalog.create_btree_index("by_lang", ["lang", "n_chars"])
        catalog.drop_index("graph")
        return catalog.as_dataframe()


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE NOT coalesce(lang = 'fr' AND n_chars < 500, false) GROUP BY lang")
def collection_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into a collection, some deleted by a filter, and the rest counted."""
    ws = Workspace(spark, scratch_folder(spark), True)
    c = Collection(ws, "docs", Schema.from_dict({"lang": "string", "n_chars": "int"}))
    c.add_dataframe(table(spark, sf_dir, "documents").select(F.col("text").alias("content"), "lang", "n_chars", "source"))
    c.delete_where({"lang": "fr", "n_chars": {"$lt": 500}})
    got = c.documents().groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    ws.close()
    return got


# -- order entry -----------------------------------------------------------------------------------------------


@query("SELECT count(DISTINCT l_partkey) AS stock_count FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey > (SELECT max(l_orderkey) FROM lineitem) - 200 AND p_size < 15")
def stock_level_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oltp.stock_level(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), order="l_orderkey", item="l_partkey", stock_item="p_partkey", quantity="p_size", last=200)


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oltp.latest_order(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"), customer="o_custkey", order="o_orderkey")


@query(
    """
    WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS n, count(*) OVER (PARTITION BY c_mktsegment) AS m FROM customer)
    SELECT c_mktsegment, c_custkey FROM r WHERE n = (m + 1) // 2
    """
)
def median_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oltp.median_by_name(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), name="c_mktsegment", order_by="c_acctbal", ident="c_custkey").select("c_mktsegment", "c_custkey")


@query(
    """
    WITH o AS (SELECT o_orderpriority, min(o_orderkey) AS order_key FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT o_orderpriority, order_key, coalesce(round(sum(l_extendedprice), 4), 0) AS amount FROM o LEFT JOIN lineitem ON l_orderkey = order_key GROUP BY ALL
    """
)
def oldest_open_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = oltp.oldest_open(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), district="o_orderpriority", order="o_orderkey", status="o_orderstatus", open_status="O", line_order="l_orderkey", amount="l_extendedprice")
    return rounded(got, "amount")


@query("SELECT c_custkey, round(c_acctbal - coalesce(paid, 0), 2) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS paid FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("amount"))
    got = oltp.pay(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), paid, ident="c_custkey", balance="c_acctbal")
    return got.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT p_partkey, q + CASE WHEN q < 10 THEN ceil((10 - q) / 91) * 91 ELSE 0 END AS p_size FROM (SELECT p_partkey, p_size - coalesce(sold, 0) AS q FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS sold FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)")
def new_orders_restock(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("sold"))
    return oltp.restock(table(spark, sf_dir, "part").select("p_partkey", "p_size"), sold, item="p_partkey", quantity="p_size")


# -- evaluation of distances on one pair of rows: all three metrics at once ---------------------------------------


@query(
    "SELECT a.vec_id, "
    + ", ".join(f"round({sql_distance(m, 'a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, 4) + 0 AS {m}" for m in ("l2", "ip", "cosine"))
    + " FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
)
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    both = rows.select("vec_id", F.col("embedding").alias("a")).join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return rounded(both.select("vec_id", *[distance(m, F.col("a"), F.col("b")).alias(m) for m in ("l2", "ip", "cosine")]), "l2", "ip", "cosine")


# -- calls of the engine's own objects; these register themselves ------------------------------------------------------

from skarn import api_queries  # noqa: E402, F401
