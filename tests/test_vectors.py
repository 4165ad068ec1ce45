import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.catalog import SearchParams
from skarn.functions.distance import block, distance, normalised
from skarn.indices import DiskANN, HnswIndex, IVFPQIndex
from skarn.operators import graph, ivfpq
from skarn.operators.knn import _merged, knn, knn_join, medoids, within
from skarn.plans import evaluate
from skarn.sources.vectors import read_filtered_benchmark, read_vectors, write_vectors


def frame(spark, x, tags=None):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize(
    "metric, vectors, expected",
    [
        ("l2", [[1.1, 0, 0, 0], [2, 0, 0, 0]], [0.01, 1.0]),
        ("ip", [[0.5, 0, 0, 0], [1, 0, 0, 0], [2, 0, 0, 0]], [0.5, 0, -1]),
        ("cosine", [[5, 0, 0, 0], [0, 1, 0, 0], [-1, 0, 0, 0], [0, 0, 0, 0]], [0, 1, 2, 1]),
    ],
)
def test_distances(spark, metric, vectors, expected):
    q = [1.0, 0, 0, 0]
    got = frame(spark, vectors).select(distance(metric, F.col("embedding"), q).alias("d")).collect()
    assert np.allclose([r.d for r in got], expected, atol=1e-6)
    assert np.allclose(block(metric, np.array([q]), np.array(vectors))[0], expected, atol=1e-6)


def test_normalised(spark):
    got = frame(spark, [[3, 4], [0, 0]]).orderBy("vec_id").select(normalised(F.col("embedding")).alias("v")).collect()
    assert np.allclose(got[0].v, [0.6, 0.8]) and got[1].v == [0, 0]


def test_ties_and_padding(spark):
    df = frame(spark, [[0, 0], [0, 0], [1, 0], [0, 0]])
    assert [r.vec_id for r in knn(df, [0, 0], 3).orderBy("rank").collect()] == [0, 1, 3]
    q = df.filter("vec_id < 2")
    got = knn_join(q, df, 6, padded=True).orderBy("qid", "rank").collect()
    assert [r.id for r in got[:6]] == [0, 1, 3, 2, -1, -1] and got[5].distance == float("inf")
    assert knn_join(df.filter("vec_id < 0"), df, 3).count() == 0
    assert knn_join(q, df.filter("vec_id < 0"), 3).count() == 0
    assert within(df, [0, 0], 0.5, "l2").count() == 3


def test_merged_keeps_ties():
    """Against a sort of all: batches of few distinct distances, and of several sizes."""
    rng = np.random.default_rng(6)
    best_d, best_i, all_d, all_i = np.zeros((7, 0)), np.zeros((7, 0), np.int64), [], []
    for n in (1, 3, 40, 5, 200):
        d, ids = rng.integers(0, 4, (7, n)).astype(float), rng.permutation(1000)[:n] + 1000 * len(all_d)
        best_d, best_i = _merged(best_d, best_i, d, ids, 6)
        all_d.append(d), all_i.append(np.broadcast_to(ids, d.shape))
        x, i = np.hstack(all_d), np.hstack(all_i)
        order = np.lexsort((i, x), axis=1)[:, :6]
        assert np.array_equal(best_i, np.take_along_axis(i, order, 1)) and np.array_equal(best_d, np.take_along_axis(x, order, 1))


def test_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    df = frame(spark, rng.normal(size=(300, 8)))
    whole = {(r.qid, r["rank"]): r.id for r in knn_join(df, df, 4).collect()}
    monkeypatch.setattr("skarn.operators.knn.QUERY_BYTES", 8 * 8 * 100)
    assert {(r.qid, r["rank"]): r.id for r in knn_join(df, df, 4).collect()} == whole
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()])
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert all(whole[i, 1] == i and whole[i, 2] == np.argsort(d[i], kind="stable")[1] for i in range(300))


def test_medoids(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.4, 0.1], 1), (3, [9.0, 9.0], 2)], "vec_id long, embedding array<float>, label int")
    assert {r.label: r.medoid for r in medoids(df, "label").collect()} == {1: 2, 2: 3}


def test_hnsw_index(workspace):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    index = HnswIndex(workspace, 1000, 16, M=8, ef_construction=40, name="h")
    assert not index.was_recovered()
    assert index.add_points(x[:300]) == list(range(300))
    assert index.add_points(x[300:])[-1] == 399
    labels, distances = index.search_knn(x[7], 5)
    assert labels[0] == 7 and distances[0] < 1e-3 and (np.diff(distances) >= 0).all()
    exact, _ = index.search_knn_parallel(x[:40], 10)
    near, _ = index.search_knn_parallel(x[:40], 10, 64, approximate=True)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, near)]) >= 0.9
    assert index.get_layers().orderBy("layer").first().nodes == 400
    again = HnswIndex(workspace, 1000, 16, M=8, ef_construction=40, name="h")
    assert again.was_recovered() and again.get_count() == 400
    with pytest.raises(ValueError):
        index.add_points(np.zeros((700, 16)))
    assert not HnswIndex(workspace, 1000, 16, M=9, ef_construction=40, name="h").was_recovered()


def test_diskann(workspace):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 16)).astype(np.float32)
    index = DiskANN(workspace, 16, 1000, R_max_degree=16, is_dynamic=True, name="d")
    index.build(x, [[i % 4] for i in range(200)])
    assert index.search(x[5], 3)[0][0] == 5
    labels, _ = index.search_with_filter(x[5], 2, 10)
    assert len(labels) == 10 and all(i % 4 == 2 for i in labels)
    near, _ = index.search_with_filter(x[6], 2, 5, SearchParams(64), approximate=True)
    assert near[0] == 6 and all(i % 4 == 2 for i in near)
    index.insert_point(x[0] + 100, [9], 1000)
    assert index.search(x[0] + 100, 1)[0][0] == 1000
    index.lazy_delete(1000)
    assert index.search(x[0] + 100, 1)[0][0] != 1000
    index.consolidate_deletes()
    assert index.get_count() == 200
    with pytest.raises(ValueError):
        DiskANN(workspace, 17, 10)
    with pytest.raises(RuntimeError):
        DiskANN(workspace, 32, 10, name="static").insert_point(np.zeros(32), [], 1)


def test_ivfpq(spark, workspace):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    index = IVFPQIndex(workspace, 5000, 16, 8, 4, name="i")
    with pytest.raises(RuntimeError):
        index.add_points(x)
    index.train(x)
    assert index.add_points(x)[-1] == 1499
    labels, _ = index.search_knn_parallel(x[:50], 5, 8)
    assert np.mean([i in row for i, row in enumerate(labels)]) > 0.8
    assert sum(index.list_sizes()) == 1500 and index.get_stats()["avg_list_size"] == 1500 / 8
    with pytest.raises(ValueError):
        ivfpq.train(frame(spark, x[:4]), 8, 4)
    truth = knn_join(frame(spark, x[:50]), frame(spark, x), 10)
    found = ivfpq.search(index.codes(), ivfpq.Model.load(index._model), frame(spark, x[:50]), 10, 8)
    assert evaluate.mean_recall(found, truth, 10) > 0.4


def test_ivfpq_ranks_all_of_its_lists(spark):
    """Without a cap on candidates: with all lists the 300 nearest are exact, and codes are ranked by what they decode to."""
    rng = np.random.default_rng(7)
    df = frame(spark, rng.normal(size=(900, 16)))
    asked = df.filter("vec_id % 30 = 0")
    model = ivfpq.train(df, 8, 4)
    codes = ivfpq.encode(df, model)
    found = ivfpq.search(codes, model, asked, 300, 8, vectors=df)
    same = lambda f: {(r.qid, r["rank"], r.id) for r in f.collect()}
    assert same(found) == same(knn_join(asked, df, 300))
    assert evaluate.mean_recall(ivfpq.search(codes, model, asked, 10, 7, vectors=df), knn_join(asked, df, 10), 10) >= 0.9
    rows = codes.collect()
    x = model.decode(np.array([list(r.codes) for r in rows]), np.array([r.cluster_id for r in rows]))
    decoded = spark.createDataFrame([(r.vec_id, v.tolist()) for r, v in zip(rows, x)], "vec_id long, embedding array<double>")
    assert same(ivfpq.search(codes, model, asked, 10, 8)) == same(knn_join(asked, decoded, 10))


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_far_rows_are_left_out_before_exact_distances(metric, monkeypatch):
    """A query's k best of all, of rows that tie, are far from the origin, zero or not finite; few pairs need exact distances."""
    from skarn.operators.knn import Nearest

    rng, met = np.random.default_rng(5), []
    pairs = Nearest._pairs
    monkeypatch.setattr(Nearest, "_pairs", lambda self, own, a, *more: (met.append(len(a)), pairs(self, own, a, *more)))
    plain = rng.normal(size=(4000, 16))
    odd = plain.copy()
    odd[::7], odd[5], odd[9, 2] = 0, np.nan, np.inf
    for x, few in ((plain, 0.05), (plain + 50, 1), (plain[rng.integers(0, 200, 4000)], 1), (odd, 1), (plain[:4], 1)):
        met.clear()
        q, ids = np.vstack([x[:1000:3], rng.normal(size=(60, 16))]), rng.permutation(len(x))
        best = Nearest(q, 10, metric)
        for at in range(0, len(x), 1700):
            best.add(ids[at : at + 1700], x[at : at + 1700])
        with np.errstate(all="ignore"):
            if metric == "l2":
                d = ((q[:, None, :] - x[None]) ** 2).sum(axis=2)
            else:
                d = np.einsum("ai,bi->ab", q, x)
                norms = np.sqrt((q * q).sum(axis=1)[:, None] * (x * x).sum(axis=1)[None, :])
                d = 1 - (d if metric == "ip" else np.where(norms < 1e-10, 0, np.clip(d / norms, -1, 1)))
        want = np.sort(d, axis=1)[:, :10]
        assert np.allclose(best.d[:, : want.shape[1]], want, atol=1e-9, equal_nan=True)
        assert (best.i[:, want.shape[1] :] == Nearest.LAST).all()
        place = np.argsort(ids)
        found = best.i[:, : want.shape[1]]
        assert np.allclose(np.take_along_axis(d, place[found], 1), want, atol=1e-9, equal_nan=True)
        assert (np.diff(np.sort(found, axis=1), axis=1) > 0).all()
        assert ((np.diff(best.d[:, : want.shape[1]], axis=1) != 0) | (np.diff(found, axis=1) > 0)).all()
        assert sum(met) <= few * d.size


def test_codebooks_are_fitted_in_tasks(spark):
    """As kmeans() fits each slice of the residuals alone; assignment needs no rounded distances."""
    x = np.random.default_rng(8).normal(size=(600, 16))
    model = ivfpq.train(frame(spark, x), 4, 4, seed=1)
    x = x.astype(np.float32).astype(np.float64)
    books = ivfpq._codebooks(spark, x - model.centroids[model.assign(x)], 4, 1)
    assert books.shape == (4, 256, 4)
    for m, (part, book) in enumerate(zip(np.split(x - model.centroids[model.assign(x)], 4, axis=1), books)):
        assert np.array_equal(book, ivfpq.kmeans(part, 256, seed=1 + m))
    near = ((x[:, None, :] - model.centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.array_equal(model.assign(x), near)


def test_list_scan_memory_does_not_grow_with_lists():
    """A task holds the k best rows of a query, not those of each list that it probes."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng, lists, asked = np.random.default_rng(9), 32, 8000
    model = ivfpq.Model(rng.normal(size=(lists, 8)), rng.normal(size=(2, 256, 4)))
    queries = (np.arange(asked), rng.normal(size=(asked, 8)), np.tile(np.arange(lists), (asked, 1)))
    n = 640
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array((np.arange(n) % lists).astype(np.int32)), pa.array([bytes(c) for c in rng.integers(0, 256, (n, 2), np.uint8)])], names=["vec_id", "cluster_id", "codes"])
    tracemalloc.start()
    found = sum(b.num_rows for b in ivfpq._scan(SimpleNamespace(value=model), SimpleNamespace(value=queries), 10)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == asked * 10 and peak < asked * lists * 10 * 16 * 1.5


def test_graph_of_no_and_one_vector():
    assert graph.Hnsw(np.zeros((0, 4))).search(np.zeros(4), 3) == []
    assert graph.Hnsw(np.ones((1, 4))).search(np.zeros(4), 3) == [(4.0, 0)]
    assert graph.Vamana(np.ones((1, 4)), 4).search(np.zeros(4), 3) == [(4.0, 0)]


def graph_recall(spark, found_of, n=6000, dim=64):
    """Of 100 vectors of n without clusters, in several parts."""
    x = np.random.default_rng(4).normal(size=(n, dim))
    df = frame(spark, x / np.linalg.norm(x, axis=1)[:, None])
    asked = df.filter(f"vec_id % {n // 100} = 0")
    pairs = [(r.vec_id, list(r.embedding)) for r in asked.collect()]
    found, rows = found_of(df, pairs)
    return evaluate.mean_recall(found, knn_join(asked, rows, 10), 10)


def test_layered_graph_recall(spark):
    """With the parameters of hnsw_graph_search, and the default part."""
    assert graph_recall(spark, lambda df, pairs: (graph.search(graph.build(df, "hnsw", m=12, ef=48), pairs, 10, 64), df)) >= 0.9


def test_tag_graph_recall_and_time(spark):
    """Queries walk side by side, and meet only nodes with the tag: 100 queries over parts of 1,000 take few distances."""

    def run(df, pairs):
        df = df.withColumn("tags", F.array(F.col("vec_id") % 7))
        graphs = graph.build(df, "vamana", tags_col="tags", part=1000, degree=16, width=32)
        found = graph.search(graphs, pairs, 10, 64, label=2, stats=True).persist()
        rows = df.filter("vec_id % 7 = 2")
        assert found.agg(F.sum(F.when(F.col("rank") == 1, F.col("dist_comps")))).first()[0] <= len(pairs) * rows.count()
        return found, rows

    assert graph_recall(spark, run) >= 0.9


def test_small_tag_graphs_are_ranked_whole(spark):
    """Graphs of up to four times a walk's width take one product and no walk; the answer is exact, and larger ones still walk."""
    x = np.random.default_rng(6).normal(size=(3000, 16))
    df = frame(spark, x).withColumn("tags", F.expr("if(vec_id < 2900, array(vec_id % 7), array(7L, 8L))"))
    graphs = graph.build(df, "vamana", tags_col="tags", part=1000, degree=8, width=16).persist()
    pairs = [(i, x[i].astype(np.float32).tolist()) for i in range(0, 3000, 50)]
    asked = df.filter("vec_id % 50 = 0")
    for label, ef, hops in ((2, 64, 3), (8, 20, 3)):
        found = graph.search(graphs, pairs, 10, ef, label, stats=True).collect()
        rows = df.filter(F.array_contains("tags", F.lit(label).cast("long")))
        n = rows.count()
        assert {(r.qid, r["rank"], r.id) for r in found} == {(r.qid, r["rank"], r.id) for r in knn_join(asked, rows, 10).collect()}
        assert {(r.dist_comps, r.hops) for r in found} == {(n, hops)}
    assert graph.search(graphs, pairs, 10, 64, 99).count() == 0
    walked = graph.search(graphs, pairs, 10, 16, 2, stats=True).collect()
    assert min(r.hops for r in walked) > 3 * 10


def test_graph_reaches_separate_clusters():
    """Clusters of equal vectors link to none but each other by nearness; all are reached nevertheless."""
    x = np.repeat(np.eye(12) * 9, 30, axis=0)
    for g in (graph.Hnsw(x, 4, 16), graph.Vamana(x, 4, 16)):
        assert all(g.search(x[i], 3, 360)[0][0] == 0 for i in range(0, 360, 30))


@pytest.mark.parametrize("name", ["a.fvecs", "a.ivecs", "a.fbin", "a.ibin", "a.npy"])
def test_vector_files(spark, tmp_path, name):
    x = np.arange(60).reshape(20, 3).astype(np.int32 if name[2] == "i" else np.float32)
    write_vectors(x, str(tmp_path / name))
    got = read_vectors(spark, str(tmp_path / name), chunk=7).orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == list(range(20)) and np.array_equal([r.embedding for r in got], x)
    part = read_vectors(spark, str(tmp_path / name), 5, 4, chunk=2).orderBy("vec_id").collect()
    assert [r.vec_id for r in part] == [5, 6, 7, 8] and np.array_equal(part[0].embedding, x[5])


def test_filtered_benchmark_files(spark, tmp_path):
    write_vectors(np.eye(3, dtype=np.float32), str(tmp_path / "vectors.npy"))
    (tmp_path / "payloads.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    (tmp_path / "tests.jsonl").write_text('{"query": [1, 0, 0]}\n')
    vectors, payloads, tests = read_filtered_benchmark(spark, str(tmp_path))
    rows = vectors.join(payloads, "vec_id")
    q = frame(spark, [[1, 0, 0]])
    got = evaluate.filtered_truth(q, rows.selectExpr("vec_id", "embedding", "cast(get_json_object(json, '$.a') as int) a"), {"a": {"$gte": 2}}, 2).collect()
    assert sorted(r.id for r in got) == [1, 2] and tests.count() == 1
    assert set(evaluate.latency(lambda: None, 5)) == {"qps", "p50_ms", "p95_ms", "p99_ms"}
