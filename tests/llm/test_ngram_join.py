import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brute import similar
from skarn.llm.components import connected_components
from skarn.llm.ngram_join import drop_similar, ngram_join


def result(df, **kw):
    return {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in ngram_join(df, **kw).collect()}


def test_against_all_pairs(docs, pdocs):
    assert result(docs) == similar(list(zip(pdocs.doc_id, pdocs.text)))


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=14), min_size=1, max_size=40), st.sampled_from([2, 1024]))
def test_small_alphabets(spark, texts, block):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df, block=block) == similar(rows)
    assert result(df, block=block, hot=2) == similar(rows)


def test_clusters_in_chunks(spark):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for j in rng.choice(60, int(rng.integers(0, 5)), replace=False):
            w[j] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    want = similar(rows)
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), block=16) == want
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=4000, hot=2) == want
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_chunks_by_size(spark):
    """A block of sets of many sizes that share a rare shingle: chunks of sizes that allow no link never meet, and no link is lost."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(160):
        w = ["rare", "shared", "words"] + [f"v{j}" for j in range(int(rng.integers(1, 60)))]
        w[int(rng.integers(3, len(w)))] = f"x{i}"
        rows.append((i, " ".join(w)))
    df, want = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), similar(rows)
    assert sum(w[1] for w in want.values()) > 100
    for kw in ({"block": 4}, {"block_bytes": 1500}, {"block": 4, "hot": 2, "percent": 50}, {"block": 4, "percent": 100}):
        assert result(df, **kw) == (similar(rows, kw["percent"]) if "percent" in kw else want)


def test_odd_rows(odd):
    got = sorted(((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in ngram_join(odd).collect()), key=str)
    by = {r[0]: r[1:] for r in got if r[0] is not None}
    assert len(got) == 12
    assert by[1] == (0, 0, 1) and by[2] == (0, 0, 2) and by[3] == (0, 0, 3)
    assert by[4] == (10, 3, 4) and by[5] == (10, 3, 4)
    assert by[10] == (1, 1, 10) and by[11] == (1, 1, 10)
    assert (None, 10, 3, 4) in got and [r for r in got if r[0] is None and r[1] != 10][0][2:] == (0, None)


def test_empty_table(none):
    assert ngram_join(none).collect() == [] and drop_similar(none).collect() == []


def test_rows_that_stay(docs, pdocs):
    want = similar(list(zip(pdocs.doc_id, pdocs.text)))
    left = drop_similar(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, w in want.items() if w[2] == i}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in list(root)}


@pytest.mark.parametrize("percent", [30, 100])
def test_other_thresholds(docs, pdocs, percent):
    assert result(docs, percent=percent) == similar(list(zip(pdocs.doc_id, pdocs.text)), percent)
