import collections
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from skarn import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) if math.isfinite(value) else str(value)
    return float(value) if type(value).__name__ == "Decimal" else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(tuple(same(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, sf, name):
    got = queries.QUERIES[name](spark, sf)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"hnsw_graph_recall"}))
def test_without_sql(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_graph_recall(spark, sf):
    assert queries.QUERIES["hnsw_graph_recall"](spark, sf).first().recall >= 0.9


def mean_recall(spark, name, filter=None):
    """Of the registered query on 2,000 vectors, for the whole query set against brute force."""
    sf = "/root/testdata/sf0.1"
    rows, asked = queries.tagged(spark, sf), queries.query_set(spark, sf)
    truth = queries.knn_join(asked, queries.where(rows, filter) if filter else rows, 10, "l2")
    found = queries.QUERIES[name](spark, sf).collect()
    assert len({r.qid for r in found}) == asked.count() == 100
    return queries.evaluate.mean_recall(spark.createDataFrame(found), truth, 10)


def test_ivfpq_recall(spark):
    assert mean_recall(spark, "ivfpq_train_search") >= 0.9
    got = {r.nprobe: r.recall for r in queries.QUERIES["ivfpq_recall"](spark, "/root/testdata/sf0.1").collect()}
    assert got[queries.NPROBE] >= 0.9


def test_ivfpq_recall_with_a_missing_vector(spark, tmp_path):
    """A query without a vector counts as one of the query set, as in SQL."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows.withColumn("embedding", queries.F.expr("if(vec_id = 40, null, embedding)")).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.QUERIES["ivfpq_recall_reached"](spark, str(tmp_path)).first()
    assert (got.queries, got.recall_reached) == (25, True)


def test_tag_recall(spark):
    got = mean_recall(spark, "vamana_tag_search", {"tags": {"$contains": 22}})
    assert got >= 0.9


def test_stream_of_a_folder(spark, tmp_path):
    """A table of several files, as larger ones are."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["stream_into_collection"](spark, str(tmp_path)).collect()
    assert sum(r.n for r in got) == sum(r.ids for r in got) == docs.count()
