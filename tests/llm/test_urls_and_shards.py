import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.llm.queries import URL_RULES
from skarn.llm.sharding import schedule, shard_documents, write_shards
from skarn.llm.url_filter import Index, url_filter


def judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best[0] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "://x.org/a", "http://EXAMPLE.org/es/1?x#y", "https://example.org/en/17", "http://a.b.example.org/en/2", "http://notexample.org/es/", "http://example.org.evil/es/",
    "http://x.com", "http://x.com/fr/é", "http://x.com/de/a?b/c", "http://x.com?u=://y.com/de/", "http://com/de/", "http://x.com#/de/", "http://x.org:80/", "http://.org/", "ftp://É.COM/de/x\ny", "http://x.com/de", "a://b://c.com/de/",
]


def test_against_brute_force(spark, sf, none):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, None)], "page_id long, url string").selectExpr("*", "'x' as rule", "1 as host", "cast(null as int) as html")
    got = sorted(map(tuple, url_filter(pages, URL_RULES).collect()), key=str)
    assert got == sorted([(i, *judge(u, URL_RULES)) for i, u in [*enumerate(URLS), (0, None)]], key=str)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert sorted(map(tuple, url_filter(pages, URL_RULES).collect())) == sorted((r.page_id, *judge(r.url, URL_RULES)) for r in pages.collect())
    assert url_filter(pages.limit(0), URL_RULES).collect() == []
    assert {r.verdict for r in url_filter(pages, [], default="block").collect()} == {"block"}


def test_collisions_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: len(b))
    Index.build([("block", "a.com/x"), ("allow", "b.com/y")], str(tmp_path / "i"))
    index = Index(str(tmp_path / "i"))
    assert [index.rule(k) if k >= 0 else None for k in index.probe([b"b.com/y", b"c.com/z", b"a.com/x", b"q"])] == [b"b.com/y", None, b"a.com/x", None]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 60)), max_size=12, unique_by=lambda x: x[0]), st.integers(1, 7))
def test_schedule_is_lpt(sizes, shards):
    loads = [0] * shards
    for size, count in sorted(sizes, reverse=True):
        for _ in range(count):
            s = min(range(shards), key=lambda s: (loads[s], s))
            loads[s] += size
    got = [0] * shards
    seen = defaultdict(list)
    for size, first, last, s in schedule(sizes, shards):
        got[s] += size * (last - first + 1)
        seen[size] += range(first, last + 1)
    assert sorted(got) == sorted(loads)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in sizes}


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_shards(request, table):
    df = request.getfixturevalue(table)
    rows = df.select("doc_id", "text").collect()
    got = shard_documents(df).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows), key=str)
    for s, members in itertools.groupby(sorted(got, key=lambda r: r.shard), lambda r: r.shard):
        assert 0 <= s < 24 and sorted(r.slot for r in members) == list(range(sum(r.shard == s for r in got)))
    where = defaultdict(set)
    for r in got:
        where[r.group_sha256].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    if table == "docs":
        loads = np.bincount([r.shard for r in got], [r["size"] for r in got], 24)
        assert loads.max() - loads.min() <= max(r["size"] for r in got)


def test_files(spark, docs, none, tmp_path):
    assert shard_documents(none).collect() == []
    write_shards(docs, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 5
