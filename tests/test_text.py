import pytest
from pyspark.sql import functions as F

from skarn.functions.text import STOP_WORDS, Analyzer, counted, snippet, tokens
from skarn.operators import hybrid
from skarn.operators.text import TextIndex
from skarn.sources.documents import chunk_documents


def terms(spark, text, analyzer=Analyzer.STANDARD):
    return spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"), analyzer)).first()[0]


def test_analyzers(spark):
    assert terms(spark, "C++ is a café, 2nd x") == ["caf", "2nd"]
    assert terms(spark, "日本語テキスト") == [] and terms(spark, None) == [] and terms(spark, "") == []
    assert terms(spark, "The Cat-dog", Analyzer.WHITESPACE) == ["the", "catdog"]
    assert terms(spark, "The Cat-dog", "none") == ["thecatdog"]
    assert len(STOP_WORDS) == 33


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(0, "cat cat cat cat cat"), (1, "cat dog bird"), (2, "fish bird tree"), (3, ""), (4, None)], "doc_id long, content string")
    return TextIndex.build(docs)


@pytest.mark.parametrize(
    "query, expected",
    [
        ("cat", [(0, 0.792067), (1, 0.507772)]),
        ("cat cat", [(0, 1.584135), (1, 1.015544)]),
        ("cat bird", [(1, 1.015544), (0, 0.792067), (2, 0.507772)]),
        ("", []),
        ("xyz", []),
    ],
)
def test_bm25(index, query, expected):
    got = index.search(query, 10).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in got] == expected


def test_filtered_search_keeps_global_statistics(spark, index):
    ids = spark.createDataFrame([(1,)], "doc_id long")
    got = index.search("cat", 10, ids).collect()
    assert [(r.doc_id, round(r.score, 6)) for r in got] == [(1, 0.507772)]
    stats = index.stats().first()
    assert (stats.vocab_size, stats.doc_count, stats.total_doc_length) == (5, 3, 11)


def test_index_files(spark, index, tmp_path):
    index.write(str(tmp_path))
    again = TextIndex.read(spark, str(tmp_path))
    assert [r.doc_id for r in again.search("bird", 5).orderBy("rank").collect()] == [1, 2]
    batch = again.search_batch(spark.createDataFrame([(7, "bird"), (8, "fish")], "qid int, query string"), 1)
    assert {(r.qid, r.doc_id) for r in batch.collect()} == {(7, 1), (8, 2)}


def test_rrf_and_weighted(spark):
    v = spark.createDataFrame([(0, 0.1), (1, 0.2), (2, 0.3)], "doc_id long, distance double")
    t = spark.createDataFrame([(1, 5.0), (0, 4.0)], "doc_id long, score double")
    got = hybrid.rrf(v, t, 5).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in got] == [(0, 0.032522), (1, 0.032522), (2, 0.015873)]
    got = {r.doc_id: round(r.score, 6) for r in hybrid.weighted(v, t, 5).collect()}
    assert got == {0: 0.5, 1: 0.75, 2: 0.0}
    got = {r.doc_id: round(r.score, 6) for r in hybrid.weighted(v, t, 5, strict=True).collect()}
    assert got == {0: 0.0, 1: 0.75, 2: 0.5}
    one = hybrid.weighted(v.limit(1), t.limit(1), 5).collect()
    assert {round(r.score, 6) for r in one} == {0.25}


def test_rerank_pack_and_snippet(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 0.0, "a b c", "s1"), (2, 2, 0.5, 86400.0, "d e", None), (3, 3, 0.1, None, "f", "s3")], "doc_id long, rank int, score double, timestamp double, content string, source string")
    got = hybrid.rerank_recency(rows, 3, 0.5, 86400.0).collect()
    assert [r.doc_id for r in got] == [2, 1, 3]
    packed = hybrid.pack_context(rows, 5)
    assert packed.count() == 2
    assert hybrid.context_text(packed).first().context == "[Source: s1]\na b c\n\n---\n\n[Source: unknown]\nd e"
    assert [r.doc_id for r in hybrid.excluding(rows, [1], 1).collect()] == [2]
    text = " ".join(["w"] * 40 + ["Cat."] + ["w"] * 40)
    got = spark.createDataFrame([(text,), ("short cat",)], "t string").select(snippet(F.col("t"), ["cat"]).alias("s")).collect()
    assert got[0].s.startswith("...") and got[0].s.endswith("Cat....") and len(got[0].s.split()) == 30
    assert got[1].s == "short cat"


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, None), (3, "  "), (4, "")], "doc_id long, text string")
    got = chunk_documents(docs, 4, 2).orderBy("chunk_no").collect()
    assert [(r.doc_id, r.chunk) for r in got] == [(1, "abcd"), (1, "cdef"), (1, "efgh"), (1, "ghij"), (1, "ij")]


def test_counted_equals_tokens(spark):
    """Terms counted row by row from bytes, against tokens(); also of texts that touch in a batch, are null or have no term."""
    texts = ["ab", "Cd", None, "", "the a of", "x \u00e9ab-AB_ab\u212a9", "ab" * 3, "...", "\u0130stanbul zz\n9z", "z"] + [f"W{i % 7}x w{i % 3}{'q' * (i % 5)} \U0001f600t{i}" for i in range(2500)]
    docs = spark.createDataFrame([(i + 5, t) for i, t in enumerate(texts)], "doc_id long, content string").coalesce(1)
    want = docs.select("doc_id", F.explode(tokens(F.col("content"))).alias("term")).groupBy("doc_id", "term").count().collect()
    sizes = {r.doc_id: r.n for r in docs.select("doc_id", F.size(tokens(F.col("content"))).alias("n")).collect()}
    got = counted(docs, "doc_id", "content").collect()
    assert sorted((r.doc_id, r.term, r.tf, r.doc_len) for r in got) == sorted((r.doc_id, r.term, r["count"], sizes[r.doc_id]) for r in want)
    assert {r.doc_id: r.doc_len for r in counted(docs, "doc_id", "content", True).collect()} == {i: n for i, n in sizes.items() if n}


def test_stored_index_moves_postings_once(spark, tmp_path):
    """Rows that share an id still are one document; others need no shuffle before the one that lays postings out."""
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb"), (2, "cc bb"), (3, "")], "doc_id long, content string")
    TextIndex.build(docs).write(str(tmp_path / "twice"))
    got = TextIndex.read(spark, str(tmp_path / "twice"))
    assert sorted(map(tuple, got.postings.select("term", "doc_id", "tf", "doc_len").collect())) == [("aa", 1, 2, 3), ("bb", 1, 1, 3), ("bb", 2, 2, 3), ("cc", 2, 1, 3)]
    plan = TextIndex.build(docs.filter("doc_id <> 2"))._rows(str(tmp_path / "once"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
