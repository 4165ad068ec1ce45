import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.functions.generate import fnv1a, zipf, zipf_column
from skarn.operators.ordered import OrderedIndex, bitmap, bitmap_count, id_difference, id_intersection, id_union
from skarn.plans import oltp


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(0, "a", 1), (1, "a", 2), (2, "b", 1), (3, "b", None), (4, "technology", 1), (5, "tech", 1)], "doc_id long, k string, n int").cache()


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_lookups(rows):
    i = OrderedIndex(rows, ["k", "n"])
    assert ids(i.lookup("a", 2)) == [1] and ids(i.prefix_lookup("a")) == [0, 1]
    assert ids(i.prefix_range_scan(["a"], 2)) == [1] and ids(i.prefix_lookup("tech")) == [5]
    assert i.contains("b", 1) and not i.contains("b", 9) and i.entry_count() == 5
    assert ids(i.scan(descending=True))[0] == 4 and ids(i.last("a")) == [1] and ids(i.first()) == [0]
    n = OrderedIndex(rows, ["n"])
    assert ids(n.less_than(2)) == [0, 2, 4, 5] and ids(n.greater_than(1)) == [1] and ids(n.range_scan(1, 2, False, True)) == [1]
    for bad in (lambda: i.lookup("a"), lambda: i.prefix_lookup(), lambda: i.prefix_range_scan(["a", 1], 1), lambda: OrderedIndex(rows, ["zz"]), lambda: OrderedIndex(rows, [])):
        with pytest.raises(ValueError):
            bad()


def test_files(spark, rows, tmp_path):
    OrderedIndex(rows, ["k", "n"]).write(str(tmp_path / "i"))
    assert ids(OrderedIndex(spark.read.parquet(str(tmp_path / "i")), ["k", "n"]).lookup("b", 1)) == [2]
    with pytest.raises(ValueError, match="duplicate"):
        OrderedIndex(rows, ["n"], unique=True).write(str(tmp_path / "j"))


def test_id_sets(spark, rows):
    a, b = rows.filter("n = 1"), rows.filter("k = 'b'")
    assert sorted(ids(id_union(a, b))) == [0, 2, 3, 4, 5] and ids(id_intersection(a, b)) == [2] and sorted(ids(id_difference(a, b))) == [0, 4, 5]
    assert bitmap_count(bitmap(rows.union(rows))).first().n == 6


def test_transactions(spark):
    orders = spark.createDataFrame([(1, 1, "F"), (2, 1, "O"), (3, 2, "O")], "o int, d int, s string")
    lines = spark.createDataFrame([(2, 5.0), (2, 6.0), (3, 1.0)], "lo int, a double")
    got = {r.d: (r.order_key, r.amount) for r in oltp.oldest_open(orders, lines, district="d", order="o", status="s", open_status="O", line_order="lo", amount="a").collect()}
    assert got == {1: (2, 11.0), 2: (3, 1.0)}
    stock = spark.createDataFrame([(1, 20), (2, 50)], "i int, q int")
    sold = spark.createDataFrame([(1, 15)], "i int, sold int")
    assert {r.i: r.q for r in oltp.restock(stock, sold, item="i", quantity="q").collect()} == {1: 96, 2: 50}


def test_generators(spark):
    assert int(fnv1a(np.array([0]))[0]) == 0xA8C7F832281A39C5
    z = zipf(np.random.default_rng(0).random(5000), 100, 0.99)
    assert z.min() == 1 and z.max() <= 100 and (z == 1).mean() > 0.1
    df = spark.range(1000).selectExpr("rand(1) u").select(zipf_column(F.col("u"), 50, 0.9, 10).alias("z"))
    assert df.agg({"z": "min"}).first()[0] >= 10 and df.agg({"z": "max"}).first()[0] < 60


def test_dealt_grows_in_number(spark, tmp_path):
    """Requests go to partitions by the bytes of their files, which adaptive plans don't merge."""
    from skarn.plans.layout import dealt

    spark.range(200_000).selectExpr("id", "hash(id) % 1000 k").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    few, many = dealt(t, "k", like=t), dealt(t, "k", like=t, most=50_000)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < many.rdd.getNumPartitions()
    assert many.count() == 200_000
