"""What changes over time: indices that are added to, folders that are locked, blocks of queries."""

import json
import os

import numpy as np
import pytest

from skarn.collection import Collection
from skarn.operators import knn
from skarn.operators.stored import LogTable, MetadataIndex
from skarn.schema import Schema
from skarn.session import Workspace


def test_lock_of_another_host(spark, tmp_path):
    at = tmp_path / "ws"
    Workspace(spark, str(at)).close()
    (at / "_lock.json").write_text(json.dumps({"pid": 1, "host": "another"}))
    with pytest.raises(RuntimeError, match="another"):
        Workspace(spark, str(at))
    (at / "_lock.json").write_text(json.dumps({"pid": 99_999_999}))
    Workspace(spark, str(at)).close()


def test_ivfpq_index_finds_later_documents(spark, workspace):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    c = Collection(workspace, "c", Schema(), vector_dim=8, distance_metric="l2")
    c.add([f"t{i}" for i in range(50)], [{}] * 50, x[:50].tolist())
    c.create_ivfpq_index("i", num_clusters=4, num_subquantizers=2, nprobe=4)
    c.add([f"t{i}" for i in range(50, 60)], [{}] * 10, x[50:].tolist())
    c.delete([55])
    for i in (3, 57):
        want = [j for j in np.argsort(((x - x[i]) ** 2).sum(axis=1)).tolist() if j != 55][:5]
        got = c.search_vector(x[i].tolist(), "i", 5)
        assert [r.doc_id for r in got] == want and abs(got[0].score) < 1e-6
    cosine = Collection(workspace, "d", Schema(), vector_dim=8)
    cosine.add(["t"] * 50, [{}] * 50, x[:50].tolist())
    cosine.create_ivfpq_index("j", num_clusters=4, num_subquantizers=2, nprobe=1)
    d = 1 - (x[:50] @ x[3]) / np.linalg.norm(x[:50], axis=1) / np.linalg.norm(x[3])
    assert [r.doc_id for r in cosine.search_vector(x[3].tolist(), "j", 5)] == np.argsort(d)[:5].tolist()


def test_text_index_grows_by_parts(spark, workspace):
    c = Collection(workspace, "c", Schema.from_dict({"title": "string", "n": "int"}))
    c.create_text_index("t", fields=["content", "title"])
    with pytest.raises(ValueError):
        c.create_text_index("u", fields=["n"])
    assert c.text_index("t").stats().first().doc_count == 0
    c.add(["alpha beta", "beta gamma"], [{"title": "one"}, {"title": "delta"}])
    assert [r.doc_id for r in c.search_text("delta", "t", 3)] == [1]
    at = c.catalog.path_of(c.catalog.get_index_info("t"))
    before = {e: os.stat(os.path.join(at, e)).st_mtime_ns for e in os.listdir(at)}
    c.add(["delta delta"], [{"title": "three"}])
    assert [r.doc_id for r in c.search_text("delta", "t", 3)] == [2, 1]
    assert all(os.stat(os.path.join(at, e)).st_mtime_ns == t for e, t in before.items()) and len(os.listdir(at)) == 2
    c.delete([1])
    assert [r.doc_id for r in c.search_text("delta", "t", 3)] == [2] and c.text_index("t").stats().first().doc_count == 2
    c.compact()
    assert [r.doc_id for r in c.search_text("beta", "t", 3)] == [0] and len(os.listdir(at)) == 1


def test_query_blocks(spark, monkeypatch):
    """Queries of several blocks give what one block gives, with one block on the driver at a time."""
    rows = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(70)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, knn.knn_join(rows, rows, 3).collect()))
    monkeypatch.setattr(knn, "QUERY_BYTES", 8 * 4 * 20)
    assert sorted(map(tuple, knn.knn_join(rows, rows, 3).collect())) == want


def test_log_table(spark, tmp_path):
    t = LogTable(spark, str(tmp_path / "t"), "a long, b string, c double", ["a", "b"])
    assert t.count() == 0 and not t.contains(1, "x")
    t.insert([(1, "x", 0.5), (1, "y", 1.5), (2, "x", None)])
    with pytest.raises(ValueError):
        t.insert([(3, "z", 0.0), (3, "z", 1.0)])
    with pytest.raises(KeyError):
        t.update([(9, "x", 0.0)])
    t.put([(1, "x", 7.0), (4, "w", 4.0)])
    assert t.remove([(2, "x"), (9, "q")]) == 1 and t.lookup(1, "x").first().c == 7.0
    again = LogTable(spark, str(tmp_path / "t"), "a long, b string, c double", ["a", "b"])
    assert [tuple(r) for r in again.ordered().scan(descending=True).collect()] == [(4, "w", 4.0), (1, "y", 1.5), (1, "x", 7.0)]
    again.compact()
    assert again.count() == 3 and len(os.listdir(tmp_path / "t")) == 1


def test_unique_metadata_index(spark, tmp_path):
    index = MetadataIndex(spark, str(tmp_path / "i"), {"k": "string"}, unique=True)
    index.insert([("a", 1), ("b", 2)])
    with pytest.raises(ValueError):
        index.insert([("a", 3)])
    assert index.index().lookup("a").first().doc_id == 1 and index.remove([("a",)]) == 1 and not index.contains("a")
