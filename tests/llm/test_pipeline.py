import corpus_pipeline
from skarn.llm import queries


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "ngram_join", "substring_dedup", "packing"]
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf).cache()
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        counts.append(now.count())
    assert all(a >= b for a, b in zip(counts, counts[1:])) and counts[-1] < counts[0]
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in now.collect()}


def test_registered_queries():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(f"op{i}" for i in range(1, 11))


def test_odd_rows(spark, odd, none, sf):
    for table in (odd, none):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf).cache()
            assert now.columns == table.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, sf).count() >= 0


def test_tables_of_earlier_stages_go(spark, sf, tmp_path):
    """A stage deletes what earlier stages stored on the way, but nothing that a pending result reads."""
    from skarn.llm.common import Leftovers, stored

    def files(df):
        return df.inputFiles()

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    left = Leftovers()
    one = left.step(lambda: stored(docs.filter("doc_id < 9"), "one"), docs)
    two = left.step(lambda: stored(docs.filter("doc_id < 8"), "two"), docs)
    assert one.count() == 9 and two.count() == 8  # the same input: both stay
    lazy = left.step(lambda: stored(one.filter("doc_id < 7"), "three"), one)
    assert one.count() == 9 and lazy.count() == 7  # `one` is read still; `two` has gone
    assert len(left.tables) == 2 and not any("two" in p for p, _ in left.tables)
    lazy.write.parquet(str(tmp_path / "written"))
    again = spark.read.parquet(str(tmp_path / "written"))
    last = left.step(lambda: stored(again.filter("doc_id < 6"), "four"), again)
    assert last.count() == 6 and len(left.tables) == 1 and "four" in left.tables[0][0]
    assert files(last)
