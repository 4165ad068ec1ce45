import zlib

import numpy as np

from skarn.llm.language_id import Space, _symbols, language_id


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(df.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == df.count() and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, odd, none):
    got = sorted(map(tuple, language_id(odd).collect()), key=str)
    by = {r[0]: r for r in got if r[0] is not None}
    assert len(got) == 12 and all(by[i][2:] == ("und", 0.0) for i in (1, 2, 3, 9))
    assert by[8][2] == "de" and by[10][2:] == by[11][2:]
    assert language_id(none).collect() == []
    blank = spark.createDataFrame([(1, "text", None), (2, "12 34", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id(blank).collect()} == {"und"}


def test_prediction_uses_the_text_alone(spark, docs):
    a = {r.doc_id: r.lang_pred for r in language_id(docs).collect() if r.held_out}
    other = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 'zz' else lang end as lang", "'s' as source")
    assert {r.doc_id: r.lang_pred for r in language_id(other).collect() if r.held_out} == a


def test_many_languages(spark):
    """3,000 values of lang, each on its own letters' text: all are learned, in blocks, and all rows come back."""
    rows = [(2 * i + j, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for _ in range(5)), f"l{i}") for i in range(3000) for j in range(2)]
    got = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), block=700).collect()
    want = {i: x for i, _, x in rows}
    learned = {x for i, _, x in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(got) == 6000 and {r.lang_pred for r in got} <= learned and len(learned) > 2700
    assert sum(r.lang_pred == want[r.doc_id] for r in got) / sum(x in learned for x in want.values()) > 0.9


def plain(rows, dim):
    """doc_id -> cosines by language, letter by letter."""
    space, table = Space(dim), _symbols()

    def unit(v):
        return v / max(np.linalg.norm(v), 1e-9)

    def bundle(text):
        s = [int(table[ord(c)]) for c in f" {(text or '').lower()} "]
        s = [a for i, a in enumerate(s) if i == 0 or a or s[i - 1]]
        out = np.zeros(dim)
        for a, b, c in zip(s, s[1:], s[2:]):
            out += space.first[a].astype(int) * space.second[b] * space.third[c]
        return unit(out), any(s)

    sums = {}
    for i, text, lang in rows:
        v, letters = bundle(text)
        if i is not None and lang is not None and letters and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + v
    means = {k: unit(v) for k, v in sums.items()}
    centre = sum(means.values()) / len(means) if len(means) > 1 else 0
    out = {}
    for i, text, _ in rows:
        v, letters = bundle(text)
        out[i] = {k: float(unit(v - centre) @ unit(m - centre)) for k, m in means.items()} if letters else {}
    return out


def test_against_plain_loops(spark, pdocs):
    some = [(int(r.doc_id), r.text, r.lang) for r in pdocs.sort_values("n_chars").iloc[::3].itertuples()][:60] + [(10**6, "", "en"), (10**6 + 1, "12 34", "de")]
    got = language_id(spark.createDataFrame(some, "doc_id long, text string, lang string"), dim=256).collect()
    want = plain(some, 256)
    assert len(got) == len(some)
    for r in got:
        cos = want[r.doc_id]
        if not cos:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert cos[r.lang_pred] >= max(cos.values()) - 1e-4 and abs(r.score - max(0, *cos.values())) < 1e-3
