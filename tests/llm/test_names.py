"""Columns of the input that are called as the operators' own survive, and rows that share an id lose no text."""

import pytest

import corpus_pipeline
from skarn.llm.sharding import write_shards

NAMES = ["_id", "_spans", "_text", "_mine", "_sha", "_hash", "_nth", "_in_0", "_in_1", "_t", "_s", "_key", "_hot", "_cold", "id", "digest", "kind", "owner", "component_id", "kept", "size", "shard_", "n_words", "stratum"]


@pytest.fixture(scope="session")
def clashing(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    unlike = " ".join(f"v{i}" for i in range(40))
    texts = [(1, "a " + passage), (2, "x y " + passage + " z"), (2, unlike), (2, unlike), (3, " ".join(f"u{i}" for i in range(30))), (None, passage), (4, None)]
    rows = [(i, t, "en", *[f"{n}{k}" for n in NAMES]) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in NAMES)).cache()


def test_pipeline_keeps_columns(spark, sf, clashing):
    now, kept = clashing, {tuple(r[3:]): r.text for r in clashing.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf).cache()
        assert now.columns == clashing.columns and now.dtypes == clashing.dtypes
        assert all(tuple(r[3:]) in kept for r in now.collect())
    left = [(r.doc_id, r.text) for r in now.collect()]
    assert sum(i == 2 and (t or "").startswith("v0 ") for i, t in left) == 1 and sum(i == 3 for i, _ in left) == 1
    assert all((t or "").count("w5 ") == (i != 2) for i, t in left if i in (1, 2) and "v0" not in t)


def test_shards_keep_columns(spark, clashing, tmp_path):
    write_shards(clashing, str(tmp_path / "out"), 3)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert set(clashing.columns) <= set(got.columns) and got.count() == clashing.count()
    assert sorted(str(tuple(r)) for r in got.select(clashing.columns).collect()) == sorted(str(tuple(r)) for r in clashing.collect())
