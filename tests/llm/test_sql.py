import collections
import os

import duckdb
import pytest

from skarn.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    got, want = queries.QUERIES[name](spark, sf), con.execute(queries.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    assert collections.Counter(tuple(r[n] for n in names) for r in got.collect()) == collections.Counter(tuple(r[i] for i in at) for r in want.fetchall())
