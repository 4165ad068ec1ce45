import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import base
from skarn.llm import kernel
from skarn.llm.quality import CUTOFFS, binomial_cdf, families, features, keep_good, quality_rules, upper_bound


@pytest.mark.parametrize("n, p", [(1, 0.3), (10, 0.02), (60, 0.5), (200, 0.001), (200, 0.9)])
def test_binomial(n, p):
    for k in range(-1, n + 1):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(binomial_cdf(k, n, p) - want) < 1e-9
    for k in range(n):
        assert abs(binomial_cdf(k, n, upper_bound(k, n, 0.05)) - 0.05) < 1e-6


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(["a", "b", " ", "\n", "é", "#", "|", "\t", "日", "a b c d e "]), max_size=40).map("".join), max_size=6))
def test_features(texts):
    data, offsets = kernel.buffers(pa.array(texts, pa.string()))
    assert [tuple(r) for r in features(data, offsets).tolist()] == [base(t) for t in texts]


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_rules(df, labels).collect()
    text = {r.doc_id: r.text for r in df.collect()}
    for r in got:
        b = base(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert r.kept == (not r.base_failed and r.failed_score is None)
    left = keep_good(df, labels)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in got if r.kept}


def test_guarantee(spark):
    """With many labels junk goes, and few good documents do; with few labels, only the base rules reject."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(9000):
        good = i % 3 > 0
        words = [f"{w}{'' if good else '###'}" for w in rng.choice(["one", "two", "three", "word", "more", "text"], 30)]
        words = [f"{w}{j}" for j, w in enumerate(words)]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(good), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_rules(df, lab).collect()
    assert all(r.kept == (r.doc_id % 3 > 0) for r in got)
    assert all(r.kept for r in quality_rules(df, lab.filter("doc_id < 100")).collect())
    assert all(r.kept for r in quality_rules(df, lab.filter("false")).collect())


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, None), (None, 1, 0), (5, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules(odd, labels).collect()
    assert len(got) == 12 and {r.stratum for r in got if r.doc_id in (1, 5)} == {"none"}
    want = sorted((base(r.text) for r in odd.collect()))
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert quality_rules(none, labels).collect() == [] and keep_good(none, labels).collect() == []
    assert keep_good(odd, labels).columns == odd.columns


def test_cutoffs_are_ordered():
    assert all(a > b for cs in CUTOFFS.values() for a, b in itertools.pairwise(cs))


def test_labelled_junk_goes_in_every_language(spark):
    """sf0.1 has 288 to 1,789 good labels a language, too few for cutoffs from three of them alone."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    label = {r.doc_id: r for r in labels}
    got = quality_rules(df, spark.createDataFrame(labels)).filter("not base_failed").collect()
    for lang in ("en", "de", "fr", "es"):
        mine = [r for r in got if r.stratum == lang and r.doc_id in label]
        junk = [r for r in mine if label[r.doc_id].quality == 0 and r.n_symbols > 0.05 * r.word_chars]
        good = [r for r in mine if label[r.doc_id].quality == 1 and not label[r.doc_id].toxic]
        assert len(junk) > 30 and not any(r.kept for r in junk)
        assert sum(not r.kept for r in good) <= 0.004 * len(good)


def test_families():
    assert families({"en": 1789, "de": 439, "fr": 437, "es": 288}, 0.004, 0.05) == (["en"], False, 0.025)
    assert families({"en": 1789, "es": 288}, 0.004, 0.05) == (["en"], True, 0.025)
    assert families({"en": 1789}, 0.004, 0.05, 288) == (["en"], True, 0.025)
    assert families({"en": 5000, "de": 5000}, 0.004, 0.05) == (["de", "en"], False, 0.025)
    assert families({"en": 60}, 0.004, 0.05) == ([], True, 0.05)
    assert families({}, 0.004, 0.05) == ([], False, 0.05)


def test_small_strata(spark):
    """A small stratum takes the pool's cutoffs, except those that its own labels contradict."""
    words = [f"word{i}" for i in range(30)]
    marked = words[:-3] + ["##", "##", "##"]
    rows = [(i, " ".join(words), "en") for i in range(3000)]
    rows += [(3000 + i, " ".join(words), "de") for i in range(50)] + [(3050 + i, " ".join(marked), "fr") for i in range(3)]
    rows += [(4000 + i, " ".join([f"{w}##" for w in words]), x) for i, x in enumerate(["en", "de", "fr", "it"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.range(5000).selectExpr("id as doc_id", "cast(id < 4000 as int) as quality", "0 as toxic")
    got = {r.doc_id: r.kept for r in quality_rules(df, labels).collect()}
    assert all(got[i] for i in range(3053))
    assert [got[i] for i in range(4000, 4004)] == [False, False, False, True]


def judged(rows, labels, alpha, delta, most):
    """doc_id -> kept, by plain loops: rows are (doc_id, text, stratum)."""
    measured = {i: (base(t), x or "none") for i, t, x in rows}

    def score(b):
        n = max(b[0], 1)
        return {"symbols": b[2] / max(b[1], 1), "dup_lines": b[3] * 5 / n, "repeats": b[4] / n, "word_length": b[1] / n}

    def fails_base(b):
        return b[0] < 10 or 100 * b[4] > 20 * b[0]

    good = {i for i, q, toxic in labels if q == 1 and not toxic}
    known = {}
    for i, (b, x) in measured.items():
        if i in good and not fails_base(b):
            known.setdefault(x, []).append(score(b))
    order = sorted(known, key=lambda x: (-len(known[x]), x))
    m = 0
    for n in range(1, min(most, len(order)) + 1):
        if binomial_cdf(0, len(known[order[n - 1]]), alpha) <= delta / (n + (n < len(order))) / 2:
            m = n
    own, others = order[:m], order[m:]
    part = delta / max(1, m + bool(others))
    pool = [s for x in others for s in known[x]]
    if pool and binomial_cdf(0, len(pool), alpha) > part / 2:
        pool = [s for x in order for s in known[x]]
    cut = {x: {} for x in order}
    for test in [*own, *(["*"] if pool else [])]:
        rows_ = pool if test == "*" else known[test]
        mine, failed, starts = {}, False, 1
        for k, cs in CUTOFFS.items():
            level = part / 2 / (3 * starts if failed else 1)
            before = dict(mine)
            for c in cs:
                def hits(ss):
                    return sum(s[k] > c or any(s[j] > v for j, v in before.items()) for s in ss)

                if binomial_cdf(hits(rows_), len(rows_), alpha) > level:
                    failed = True
                    break
                mine[k] = c
                for x in others if test == "*" else [test]:
                    if test != "*" or 1 - binomial_cdf(hits(known[x]) - 1, len(known[x]), alpha) >= delta:
                        cut[x][k] = c
            starts *= len(cs) + 1
    return {i: not fails_base(b) and not any(score(b)[k] > c for k, c in cut.get(x, {}).items()) for i, (b, x) in measured.items()}


@pytest.mark.parametrize("most", [256, 2])
def test_verdict_against_plain_loops(spark, most):
    """Several strata with their own tests, a pool, strata that contradict it, and (most=2) strata that the driver doesn't know."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(6500):
        x = ["en", "de", "fr", "it", "pt", None][int(rng.choice(6, p=[0.5, 0.3, 0.1, 0.04, 0.03, 0.03]))]
        quality = int(rng.random() > 0.2)
        words = [f"word{j}" for j in range(30)]
        marks = int(rng.integers(3, 30)) if not quality else int(rng.integers(1, 8)) * (rng.random() < {"fr": 0.003, "pt": 0.1}.get(x, 0.002))
        for j in range(marks):
            words[j] += "#" * int(rng.integers(1, 4))
        if rng.random() < (0.3 if not quality else 0.001):
            words += ["again", "and", "over", "this", "line"] + ["again", "and", "over", "this", "line"][: int(rng.integers(0, 6))]
        rows.append((i, " ".join(words), x))
        if rng.random() < 0.9:
            labels.append((i, quality, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality_rules(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), most=most).collect()}
    want = judged(rows, labels, 0.004, 0.05, most)
    assert got == want and 500 < sum(not k for k in want.values()) < 3000


def test_many_strata(spark):
    """3,000 strata, each with a labelled document or two: one pool, whose cutoffs reach strata that the driver doesn't know."""
    words = [f"word{i}" for i in range(30)]
    rows = [(i, " ".join(words), f"x{i % 3000}") for i in range(6000)]
    rows += [(6000 + i, " ".join([f"{w}##" for w in words]), f"x{i}") for i in range(3000)] + [(9999, " ".join([f"{w}##" for w in words]), "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.range(6000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    got = {r.doc_id: r.kept for r in quality_rules(df, labels).collect()}
    assert len(got) == 9001 and all(k == (i < 6000 or i == 9999) for i, k in got.items())
    assert keep_good(df, labels).count() == 6001
