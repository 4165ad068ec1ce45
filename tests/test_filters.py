import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from skarn.operators.filters import compile_filter, from_match_range, matches, parse_filter, parse_legacy, selectivity, where

TRUTH = [
    ({"a": 5}, {"a": 5}, True, True),
    ({"a": 5}, {"a": {"$gt": 5}}, False, False),
    ({"a": 5}, {"a": {"$gte": 5}}, True, True),
    ({}, {"a": {"$ne": 1}}, False, False),
    ({}, {"a": {"$nin": [1]}}, False, False),
    ({"a": "x"}, {"a": {"$ne": 1}}, True, True),
    ({"a": "x"}, {"a": {"$nin": [1]}}, True, True),
    ({"a": 3.7}, {"a": 3}, False, True),
    ({"a": 3.7}, {"a": {"$in": [3]}}, False, False),
    ({"a": ["x", "y"]}, {"a": {"$contains": "x"}}, True, True),
    ({"a": ["x", "y"]}, {"a": "x"}, False, False),
    ({"a": [1, 2]}, {"a": {"$contains": 2}}, True, True),
    ({"a": "xyz"}, {"a": {"$contains": "x"}}, False, False),
    ({"a": 5, "b": 1}, {"a": 5, "b": 2}, False, True),
    ({"a": 50}, {"a": {"$gte": 10, "$lte": 20}}, False, True),
    ({"a": True}, {"a": True}, True, True),
    ({"a": True}, {"a": 1}, False, False),
    ({"a": None}, {"a": {"$ne": 1}}, True, True),
    ({"a": 1}, {}, False, False),
    ({"a": 1}, {"$and": []}, True, True),
    ({"a": 1}, {"$or": []}, False, False),
    ({"a": 1}, {"a": {"$in": []}}, False, False),
    ({"a": 1}, {"a": {"$nin": []}}, True, True),
    ({"a": "b"}, {"a": {"$lt": "c"}}, True, True),
    ({"a": 2}, {"a": {"$lt": 2.5}}, True, True),
]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, json.dumps(doc)) for i, (doc, *_) in enumerate(TRUTH)]
    return spark.createDataFrame(rows, "i int, doc string").cache()


@pytest.mark.parametrize("strict", [False, True])
def test_truth_table_on_json(documents, strict):
    cols = [matches(f, documents.schema, "doc", strict).alias(f"c{i}") for i, (_, f, *_) in enumerate(TRUTH)]
    for r in documents.select("i", *cols).collect():
        assert r[f"c{r.i}"] == TRUTH[r.i][3 if strict else 2], TRUTH[r.i]


def test_typed_columns_and_pushdown(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1.5, True), (2, None, None, None)], "i long, s string, f double, b boolean").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert [r.i for r in where(df, {"s": {"$ne": "b"}}).collect()] == [1]
    assert [r.i for r in where(df, {"f": {"$gt": 1}}).collect()] == [1]
    assert where(df, "").count() == 2
    plan = where(df, {"i": {"$gte": 2}})._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(i,2)" in plan


def test_booleans(spark):
    schema = T.StructType([T.StructField("b", T.BooleanType())])
    with pytest.raises(ValueError):
        compile_filter({"b": {"$gt": False}}, schema)
    df = spark.createDataFrame([(True,), (False,)], schema)
    assert [r.b for r in where(df, {"b": {"$gt": False}}, strict=True).collect()] == [True]
    assert where(df, {"b": {"$gte": False}}, strict=True).count() == 2


def test_parsing():
    with pytest.raises(ValueError, match="Unknown filter operator"):
        parse_filter({"a": {"$foo": 1}})
    assert parse_filter("").op == "$true"
    assert parse_legacy({"and": [{"field": "a", "op": ">", "value": 1}, {"not": {"field": "b", "op": "eq", "value": 2}}]}).children[1].op == "$not"
    assert selectivity(parse_filter({"$or": [{"a": 1}, {"a": {"$ne": 1}}, {"b": {"$gt": 1}}]})) == 1.0
    spec = {"and": [{"t": {"match": {"value": "x"}}}, {"n": {"range": {"gte": 1, "lt": 5}}}, {"g": {"geo": {}}}]}
    assert from_match_range(spec, {"t"}) == {"$and": [{"t": {"$contains": "x"}}, {"n": {"$gte": 1, "$lt": 5}}]}
    assert from_match_range(None) is None


def _scan(doc, f):
    """The default semantics, written again from its table."""
    if not f:
        return False
    return all(_one(doc, k, v) for k, v in f.items())


def _one(doc, k, v):
    if k == "$and":
        return all(_scan(doc, c) for c in v)
    if k == "$or":
        return any(_scan(doc, c) for c in v)
    ops = v if isinstance(v, dict) else {"$eq": v}
    if k not in doc:
        return False
    x = doc[k]
    same = (isinstance(x, str) and all(isinstance(y, str) for y in ops.values() if not isinstance(y, list))) or isinstance(x, int)
    out = []
    for op, y in ops.items():
        if op in ("$in", "$nin"):
            out.append((x in y and same and all(type(x) is type(z) for z in y)) == (op == "$in"))
        elif type(x) is not type(y):
            out.append(op == "$ne")
        else:
            out.append({"$eq": x == y, "$ne": x != y, "$gt": x > y, "$gte": x >= y, "$lt": x < y, "$lte": x <= y}[op])
    return all(out)


values = st.one_of(st.integers(-3, 3), st.sampled_from(["a", "b", "c"]))
leaf = st.builds(lambda k, op, v: {k: {op: v}}, st.sampled_from("xyz"), st.sampled_from(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte"]), values)
lists = st.builds(lambda k, op, v: {k: {op: v}}, st.sampled_from("xyz"), st.sampled_from(["$in", "$nin"]), st.one_of(st.lists(st.integers(-3, 3), min_size=1, max_size=3), st.lists(st.sampled_from("abc"), min_size=1, max_size=3)))
trees = st.recursive(st.one_of(leaf, lists), lambda c: st.builds(lambda op, cs: {op: cs}, st.sampled_from(["$and", "$or"]), st.lists(c, max_size=3)), max_leaves=5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from("xyz"), values), min_size=1, max_size=6), st.lists(trees, min_size=4, max_size=8))
def test_random_filters(spark, docs, filters):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, doc string")
    got = df.select("i", *[matches(f, df.schema, "doc").alias(f"c{j}") for j, f in enumerate(filters)]).collect()
    for r in got:
        for j, f in enumerate(filters):
            assert r[f"c{j}"] == _scan(docs[r.i], f), (docs[r.i], f)
