import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.catalog import IndexCatalog
from skarn.collection import Collection
from skarn.operators.hybrid import FusionMethod, FusionParams
from skarn.schema import FieldType, Schema
from skarn.session import LogLevel, Workspace, buffer_config
from skarn.streaming.ingest import stream_into


@pytest.fixture()
def schema():
    return Schema().add_field("lang", "string", nullable=False).add_field("year", FieldType.INT).add_field("tags", "string[]")


def test_schema(schema):
    with pytest.raises(ValueError, match="already exists"):
        schema.add_field("lang", "int")
    with pytest.raises(ValueError, match="Missing required field: lang"):
        schema.validate({})
    for bad in ({"lang": 1}, {"lang": "x", "year": 1.5}, {"lang": "x", "year": None}, {"lang": "x", "year": True}, {"lang": "x", "tags": ["a", 1]}):
        with pytest.raises(ValueError):
            schema.validate(bad)
    schema.validate({"lang": "x", "year": 3, "tags": [], "other": {"deep": None}})
    assert Schema.from_json(schema.to_json()) == schema
    with pytest.raises(ValueError, match="Unknown field type"):
        Schema.from_dict({"a": "date"})


def test_documents(workspace, schema):
    c = Collection(workspace, "docs", schema, 2, "l2")
    with pytest.raises(ValueError, match="Index already exists"):
        Collection(workspace, "docs", schema)
    assert c.add(["a", "b"], [{"lang": "en", "year": 1}, {"lang": "fr", "x": {"y": [1]}}], [[0, 0], [1, 0]]) == [0, 1]
    with pytest.raises(ValueError):
        c.add(["c"], [{"year": 1}])
    with pytest.raises(ValueError):
        c.add(["c"], [{"lang": "en"}], [[1, 2, 3]])
    with pytest.raises(ValueError):
        c.add(["c"], [])
    assert c.add(["c", "d", "e"], [{"lang": "en", "year": y} for y in (2, 3, 4)], [[2, 0], [3, 0], [4, 0]]) == [2, 3, 4]
    got = c.get([3, 99, 1])
    assert [d.content for d in got] == ["d", "", "b"] and got[2].metadata == {"lang": "fr", "x": {"y": [1]}}
    c.update([1, 1], [{"year": 7}, {"x": 2}])
    assert c.get([1])[0].metadata == {"lang": "fr", "year": 7, "x": 2}
    with pytest.raises(KeyError):
        c.update([99], [{"year": 7}])
    with pytest.raises(ValueError):
        c.update([1], [{"year": "x"}])
    assert c.delete([0, 99]) == 1 and c.doc_count() == 4
    assert c.delete_where({"year": {"$gte": 4, "$lt": 5}}) == 1 and c.doc_count() == 3
    assert [d.id for d in c.get_where({"lang": "en"}, 1, 1)] == [3]
    assert [d.id for d in c.get_where({"x": 2})] == [1]
    assert c.add(["f"], [{"lang": "es"}]) == [5]
    again = Collection.open(workspace, "docs")
    assert again.doc_count() == 4 and again.vector_dim() == 2 and again.schema() == schema
    again.compact()
    assert sorted(r.doc_id for r in again.documents().collect()) == [1, 2, 3, 5]


def test_searches(workspace, schema):
    c = Collection(workspace, "docs", schema, 2, "cosine")
    texts = ["red apple pie", "green apple", "blue sky", "red red sky"]
    c.add(texts, [{"lang": "en", "year": i} for i in range(4)], [[1, 0], [1, 0.1], [0, 1], [-1, 0]])
    c.create_hnsw_index("v")
    c.create_text_index("t")
    c.create_metadata_index("m", ["lang", "year"], unique=True)
    assert [r.doc_id for r in c.search_vector([1, 0], "v", 2)] == [0, 1]
    got = c.search_vector([1, 0], "v", 2, '{"year": {"$gte": 1}}')
    assert [r.doc_id for r in got] == [1, 2] and got[0].document.content == "green apple"
    assert [r.doc_id for r in c.search_text("red", "t")] == [3, 0]
    assert [r.doc_id for r in c.search_text("red", "t", filter={"year": 0})] == [0]
    assert c.search_hybrid([1, 0], "v", "red apple", "t", 2)[0].doc_id == 0
    assert len(c.search_hybrid([1, 0], "v", "sky", "t", 3, FusionParams(FusionMethod.WEIGHTED))) == 3
    c.delete([3])
    assert [r.doc_id for r in c.search_text("red", "t")] == [0]
    assert 3 not in [r.doc_id for r in c.search_vector([-1, 0], "v", 4)]
    with pytest.raises(ValueError, match="not a vector index"):
        c.search_vector([1, 0], "t")
    with pytest.raises(KeyError, match="not found"):
        c.search_vector([1, 0], "none")
    with pytest.raises(ValueError, match="duplicate key"):
        c.add(["x"], [{"lang": "en", "year": 1}])
    assert c.metadata_index("m").prefix_lookup("en").count() == 3
    assert [i["name"] for i in c.list_indices()] == ["v", "t", "m"]
    c.drop_index("v")
    with pytest.raises(KeyError):
        c.drop_index("v")
    with pytest.raises(ValueError, match="not in schema"):
        c.create_metadata_index("n", ["nope"])


def test_ivfpq_route(workspace):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    c = Collection(workspace, "vecs", Schema(), 8, "l2")
    c.add([""] * 600, [{}] * 600, x.tolist())
    c.create_ivfpq_index("i", 4, 4, nprobe=4)
    got = [r.doc_id for r in c.search_vector(x[5].tolist(), "i", 10)]
    assert 5 in got and len(got) == 10
    c.delete([5])
    assert 5 not in [r.doc_id for r in c.search_vector(x[5].tolist(), "i", 10)]


def test_dataframe_and_stream(spark, workspace, schema, tmp_path):
    c = Collection(workspace, "docs", schema)
    rows = spark.createDataFrame([("a", "en", "5", 1), ("b", "fr", None, 2)], "content string, lang string, year string, extra int")
    assert c.add_dataframe(rows, "content") == (0, 2)
    assert c.get([0, 1])[0].metadata == {"lang": "en", "year": "5", "extra": 1}
    assert c.documents().filter("year = 5").count() == 1
    with pytest.raises(ValueError):
        c.add_dataframe(rows.withColumn("year", F.lit("x")))
    assert c.add_dataframe(rows, batch_id="b1")[1] == 2 and c.add_dataframe(rows, batch_id="b1")[1] == 0
    assert c.add_dataframe(rows.filter("false")) == (4, 0)
    rows.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))
    stream_into(stream, c, str(tmp_path / "ck")).awaitTermination(60)
    stream_into(stream, c, str(tmp_path / "ck")).awaitTermination(60)
    assert c.doc_count() == 6


def test_catalog_and_workspace(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "a"))
    with pytest.raises(RuntimeError, match="in use"):
        Workspace(spark, str(tmp_path / "a"))
    catalog = IndexCatalog.initialize(ws)
    assert IndexCatalog.instance() is catalog and IndexCatalog.is_initialized()
    h = catalog.create_hnsw_index("x", 8)
    assert h.index_id == 1 and catalog.index_exists("x") and catalog.open_index("x").dimensions == 8
    for name in ("", "n" * 256):
        with pytest.raises(ValueError):
            catalog.create_text_index(name)
    with pytest.raises(ValueError):
        catalog.create_btree_index("y", ["a", "b", "c", "d"])
    catalog.update_config("x", M=32)
    assert catalog.get_index_info("x").config["M"] == 32
    catalog.drop_index("x")
    assert catalog.list_indexes() == [] and catalog.create_text_index("z").index_id == 2
    ws.set_log_level("error")
    assert ws.get_log_level() is LogLevel.ERROR
    ws.force_evict_buffer_portion(0.5)
    IndexCatalog.shutdown()
    ws.close()
    with Workspace(spark, str(tmp_path / "a"), cleanup_if_exist=True) as again:
        assert IndexCatalog(again).list_indexes() == []
    assert buffer_config(2)["spark.executor.memory"] == "2048m"


def test_add_by_key_sorts_keys_only(spark, workspace):
    """Ids follow the keys, also where they are in disorder; keys that are there twice take the general way."""
    c = Collection(workspace, "keyed", Schema.from_dict({"k": "int"}))
    assert c.add_dataframe(spark.createDataFrame([("c", 30), ("a", 10), ("b", 20)], "content string, k int").repartition(3), order_by="k") == (0, 3)
    assert c._add_by_key(spark.createDataFrame([("x", 1), ("y", 1)], "content string, k int"), "k", [F.col("content")], c._manifest(), None) is None
    assert c.add_dataframe(spark.createDataFrame([("e", 2), ("d", 1), ("f", 2)], "content string, k int"), order_by="k") == (3, 3)
    assert [(r.doc_id, r.k) for r in c.documents().orderBy("doc_id").collect()] == [(0, 10), (1, 20), (2, 30), (3, 1), (4, 2), (5, 2)]
    assert "d" == c.get([3])[0].content and c.doc_count() == 6
