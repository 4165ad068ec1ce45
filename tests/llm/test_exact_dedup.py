import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.llm.exact_dedup import RadixTrie, drop_copies, exact_dedup


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=12) | st.sampled_from([b"abc", b"abcd", b"ab", b""]), st.integers(0, 99) | st.none()), max_size=60), st.sampled_from([1, 1500, 4000, 1 << 20]))
def test_trie_with_spill(items, limit):
    trie, want = RadixTrie(limit), {}
    for key, ident in items:
        trie.insert(key, ident)
        old = want.get(key, (None, 0))
        want[key] = (min((x for x in (old[0], ident) if x is not None), default=None), old[1] + 1)
    got = list(trie.drain())
    assert len(got) == len(want) and {k: (i, n) for k, i, n in got} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=8), max_size=40))
def test_trie_that_flushes(keys):
    out = []
    trie = RadixTrie(1200, flush=out.extend)
    for i, k in enumerate(keys):
        trie.insert(k, i)
    out += trie.drain()
    assert sum(n for _, _, n in out) == len(keys)
    assert {k: min(i for j, i, _ in out if j == k) for k, _, _ in out} == {k: keys.index(k) for k in keys}


def want(rows):
    key = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), k in zip(rows, key):
        group = [j for (j, _), m in zip(rows, key) if m == k]
        keep = min((j for j in group if j is not None), default=None)
        out.append((i, keep, len(group), i == keep, hashlib.sha256(k.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [2000, 96 << 20])
def test_against_brute_force(docs, odd, pdocs, limit):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, exact_dedup(df, limit=limit).collect()), key=str) == want(rows)


def test_empty_table(none):
    assert exact_dedup(none).collect() == [] and drop_copies(none).collect() == []


def test_rows_that_stay(odd):
    left = drop_copies(odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 10, 3, 4, 8, None]


def test_hot_text(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot text' else concat('t', id) end as text")
    got = exact_dedup(df)
    assert got.filter("group_size = 1000 and keep_id = 0").count() == 1000 and got.filter("kept").count() == 2001
