import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import WORD, best_alignment, shared_runs
from skarn.llm.substring_dedup import best_parts, chain, columns, cut_passages, repeated_passages


def best_chain(a, b, k, gap):
    order = sorted(range(len(a)), key=lambda i: (a[i], -b[i]))
    score = {}
    for i in order:
        score[i] = k + max([0] + [score[j] - gap * (a[i] - a[j] + b[i] - b[j]) for j in score if a[j] < a[i] and b[j] < b[i]])
    return max(score.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=14, unique=True))
def test_chains(seeds):
    a, b = (np.array(x) for x in zip(*seeds))
    got = chain(a, b, 8, 0.1)
    assert sorted(i for c in got for i in c.tolist()) == list(range(len(seeds)))
    for c in got:
        assert (np.diff(a[c]) > 0).all() and (np.diff(b[c]) > 0).all()
    c = got[0]
    value = 8 * len(c) - 0.1 * (a[c[-1]] - a[c[0]] + b[c[-1]] - b[c[0]])
    assert value >= best_chain(a.tolist(), b.tolist(), 8, 0.1) - 1e-9 or len(got) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=40))
def test_best_parts(same):
    same = np.array(same)
    parts = best_parts(same, 0.8)
    gain = np.where(same, 0.2, -0.8)
    for lo, hi in parts:
        assert same[lo:hi].mean() >= 0.8 - 1e-9 and same[lo] and same[hi - 1]
    if same.any():
        best = max(gain[i:j].sum() for i in range(len(same)) for j in range(i + 1, len(same) + 1))
        assert abs(max(gain[lo:hi].sum() for lo, hi in parts) - best) < 1e-9


def test_alignment():
    x = np.array([9, 1, 2, 3, 4, 5, 6, 7, 8])
    y = np.array([1, 2, 3, 4, 0, 0, 5, 6, 7, 8])
    xs, ys, same = columns(x, y, np.array([1, 5]), np.array([0, 6]), 4)
    assert same.sum() == 8 and len(xs) == len(ys) == len(same) == 10


def spans(df):
    out = {}
    for r in repeated_passages(df).collect():
        assert r.n_words == r.end_word - r.start_word >= 50 and r.owner_id in r.owner_ids and r.owner_id < r.doc_id
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def test_exact_runs_are_found(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = shared_runs([(r.doc_id, r.text) for r in df.collect()])
    got = spans(df)
    assert all(words <= got.get(i, set()) for i, words in want.items())


def planted(rng):
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(120)]
        if i % 5 == 0:
            p = list(passage)
            if i % 10 == 0 and i:
                for j in (20, 41, 60):
                    p[j] = word()
            w[30:30] = p
        rows.append((i, " ".join(w)))
    return rows


def test_planted_passages(spark):
    rows = planted(np.random.default_rng(0))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spans(df)
    assert set(got) == {i for i in range(1, 60) if i % 5 == 0}
    for words in got.values():
        assert len(words ^ set(range(30, 100))) <= 2
    left = {r.doc_id: r.text for r in cut_passages(df, repeated_passages(df)).collect()}
    for i, text in rows:
        w = WORD.findall(text)
        assert abs(len(WORD.findall(left[i])) - (len(w) - (70 if i in got else 0))) <= 2
        if i not in got:
            assert left[i] == text


def test_odd_rows(spark, odd, none):
    assert repeated_passages(odd).filter("doc_id <> 8").collect() == [] and repeated_passages(none).collect() == []
    empty = repeated_passages(odd).filter("false")
    assert sorted(map(str, cut_passages(odd, empty).collect())) == sorted(map(str, odd.collect()))
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 1), (2, text, 1), (3, text, None), (3, text, None), (None, text, 2)], "doc_id long, text string, owner int")
    got = repeated_passages(df)
    assert {(r.doc_id, r.start_word, r.end_word, r.owner_id) for r in got.collect()} == {(2, 0, 60, 1), (3, 0, 60, 1)}
    left = cut_passages(df, got)
    assert left.columns == df.columns and sorted(map(str, (r.doc_id for r in left.collect()))) == ["1", "None"]


def test_hot_passage(spark):
    hot = " ".join(f"w{i}" for i in range(60))
    df = spark.range(900).selectExpr("id as doc_id", f"case when id % 3 = 0 then concat('t', id, ' {hot} u', id) else concat('x', id, ' y', id) end as text").repartition(6)
    got = repeated_passages(df)
    assert got.count() == 299 and got.agg({"n_words": "min"}).first()[0] == 60


def test_unlike_texts_under_one_id(spark):
    """Each text is compared and cut on its own, in whatever order the rows come."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage), (2, "x y z " * 4 + passage), (2, "one short text"), (2, ""), (3, "w0 other " + passage), (3, passage + " end")]
    seen = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = repeated_passages(df)
        found = tuple(sorted((r.doc_id, r.start_word, r.end_word) for r in got.collect()))
        left = cut_passages(df, got).collect()
        seen.add((found, tuple(sorted(map(tuple, left)))))
    assert len(seen) == 1
    found, left = seen.pop()
    assert found == ((2, 12, 72), (3, 0, 60), (3, 2, 62))
    assert left == ((1, passage), (2, ""), (2, "one short text"), (2, "x y z " * 4), (3, "end"), (3, "w0 other "))


def test_fuzzy_rows_against_all_pairs(spark):
    """Copies with words changed, added and left out: what an alignment of all pairs finds, and nothing that it doesn't."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passages = [[word() for _ in range(90)] for _ in range(3)]
    rows = []
    for i in range(15):
        w = [word() for _ in range(40)]
        if i % 5 < 3:
            p, j = list(passages[i % 5]), 17 + int(rng.integers(0, 4))
            while i >= 5 and j < len(p):
                p[j : j + 1] = [[], [word()], [word(), p[j]]][int(rng.integers(0, 3))]
                j += 17 + int(rng.integers(0, 4))
            w[20:20] = p
        if i == 14:
            w[10:10] = passages[0][:30]  # too short to be listed
        rows.append((i, " ".join(w)))
    texts = [t.split() for _, t in rows]
    want, near = {}, {}
    for i, x in enumerate(texts):
        for y in texts[:i]:
            score, lo, hi, n, same = best_alignment(x, y)
            if n:
                near.setdefault(i, set()).update(range(lo - 3, hi + 3))
            if hi - lo >= 50:
                assert same >= 0.8 * n
                want.setdefault(i, set()).update(range(lo, hi))
    assert set(want) == {5, 6, 7, 10, 11, 12}
    got = spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(got) == set(want)
    for i, words in want.items():
        assert len(words & got[i]) >= 0.97 * len(words) and got[i] <= near[i]
