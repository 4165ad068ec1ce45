"""Quality rules with cutoffs whose false rejection is bounded on labelled holdouts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import kernel
from skarn.llm.common import drop_stored, stored

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: For each score, cutoffs from the mildest to the most severe. A document fails above a cutoff.
CUTOFFS = {
    "symbols": [1.0, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01],
    "dup_lines": [1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.025, 0.02, 0.015, 0.01],
    "repeats": [0.19, 0.17, 0.15, 0.13, 0.11, 0.1, 0.09, 0.08, 0.07, 0.06, 0.05, 0.04, 0.03, 0.02],
    "word_length": [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0],
}


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """BASE for every document, one column each."""
    n = len(offsets) - 1
    starts, ends, counts = kernel.words(data, offsets)
    out = np.zeros((n, 5), np.int64)
    out[:, 0] = counts
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~kernel.SPACE[data] & ((data & 0xC0) != 0x80), out=inside[1:])
    out[:, 1] = np.diff(inside[offsets])
    np.cumsum(SYMBOL[data], out=inside[1:])
    out[:, 2] = np.diff(inside[offsets])
    raw = data.tobytes()
    for i in range(n):
        a, b = offsets[i], offsets[i + 1]
        if raw.find(b"\n", a, b) < 0:
            continue
        lines = raw[a:b].split(b"\n")
        if len(lines) - len(set(lines)):
            seen, dup = set(), 0
            for line in lines:
                if line in seen:
                    dup += 1
                elif line.strip():
                    seen.add(line)
            out[i, 3] = dup
    h, doc, at = kernel.shingles(kernel.word_hashes(data, starts, ends), counts, 5)
    if len(h):
        key = kernel.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(h), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        cover = np.zeros(len(starts) + 5, np.int32)
        hit = at[again]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 5, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[: len(starts)]) > 0)])
        edge = np.concatenate([[0], np.cumsum(counts)])
        out[:, 4] = covered[edge[1:]] - covered[edge[:-1]]
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = kernel.buffers(batch.column(0))
        parts = [features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in kernel.slices(offsets)]
        got = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(got[:, k]) for k in range(5)]], names=[*batch.schema.names[1:], *BASE])


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and BASE for every row. A null text has no words."""
    rows = docs.select(F.col(text).cast("string").alias("_text"), *[F.col(c) for c in keep])
    types = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"{c} long" for c in BASE])
    return rows.mapInArrow(_features, schema)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of Binomial(n, p), exactly: the regularised incomplete beta function."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1 or k < 0:
        return 0.0
    return _beta(n - k, k + 1, 1 - p)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 0.0
    f = 1.0
    for i in range(2000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1) / a


def upper_bound(k: int, n: int, delta: float) -> float:
    """The Clopper-Pearson upper bound of a rate, at confidence 1 - delta."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_cdf(k, n, mid) > delta else (lo, mid)
    return hi


def scores() -> dict[str, F.Column]:
    w = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "dup_lines": F.col("n_dup_lines") * 5 / w,
        "repeats": F.col("n_repeat_words") / w,
        "word_length": F.col("word_chars") / w,
    }


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def families(sizes: dict[str, int], alpha: float, delta: float, rest: int = 0) -> tuple[list[str], bool, float]:
    """From the labels of each stratum: the strata tested on their own, whether the pool's test is on all strata, and each test's part of delta.

    A stratum is tested on its own if its labels, none of them rejected, can guarantee a cutoff. The
    others (with `rest` labels of strata not in sizes) share one test on their pooled labels, or on all labels where those are too few.
    Only numbers of labels decide this, never what a cutoff rejects.
    """
    order = sorted(sizes, key=lambda x: (-sizes[x], x))

    def enough(n: int, tests: int) -> bool:
        return binomial_cdf(0, n, alpha) <= delta / tests / 2

    own = max([m for m in range(1, len(order) + 1) if enough(sizes[order[m - 1]], m + (m < len(order) or rest > 0))], default=0)
    pooled = sum(sizes[x] for x in order[own:]) + rest
    tests = max(1, own + (pooled > 0))
    return order[:own], pooled > 0 and not enough(pooled, tests), delta / tests


class Cutoffs(NamedTuple):
    """For each score, the cutoffs of the strata with most labels; the other strata's as a table (or None): stratum and a column for each score."""

    of: dict[tuple[str, str], float]
    known: list[str]
    rest: DataFrame | None


def _milder(accepted: dict[str, list[float]], alpha: float, delta: float):
    """By pooled stratum: of the pool's accepted cutoffs, those that its own labels don't contradict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n = batch.column(0), batch.column(1).to_pylist()
            counts = iter(batch.columns[2:])
            out = []
            for k in CUTOFFS:
                best: list[float | None] = [None] * len(n)
                for c in accepted.get(k, []):
                    for i, hits in enumerate(next(counts).to_pylist()):
                        if 1 - binomial_cdf(hits - 1, n[i], alpha) >= delta:
                            best[i] = c
                out.append(pa.array(best, pa.float64()))
            yield pa.RecordBatch.from_arrays([names, batch.column(1), *out], names=["_of", "_labels", *[f"_cut_{k}" for k in CUTOFFS]])

    return run


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str, alpha: float, delta: float, most: int, id_col: str = "doc_id") -> Cutoffs:
    """A cutoff for each stratum and score, where one can be guaranteed.

    Of the labelled good documents that the base rules pass, all cutoffs of a stratum together may reject a
    part of alpha, with confidence 1 - delta over all tests (Bonferroni). The `most` strata with the most labels are tested on their
    own where these are enough; all others are tested
    as one (families()): for them the guarantee is on the pool's documents, and one whose own
    labels contradict it (more rejected than a rate of alpha explains, at delta) gets milder cutoffs.
    Score after score, cutoffs are tested from mild to severe, each with all those accepted before
    (fixed-sequence testing). Half of a test's delta is for the sequence until its first failure, which ends the score's
    cutoffs. The other half is for going on with the next scores after it, shared by them and by all
    cutoffs where one could start. There may be any number of strata: only the counts of `most` reach the driver.
    """
    good = labels.filter(F.col("quality") == 1).filter(F.coalesce(F.col("toxic"), F.lit(0)) == 0).select(F.col("doc_id").alias("_id")).distinct()
    rows = measured.filter(~base_failed()).select(F.col(id_col).alias("_doc"), F.col(stratum).alias("_stratum"), *BASE)
    rows = stored(rows.join(good, F.col("_doc") == F.col("_id"), "left_semi").drop("_doc"), "good")
    by_size = stored(rows.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n")), "strata")
    sizes = {r["_stratum"]: r["_n"] for r in by_size.orderBy(F.desc("_n"), "_stratum").limit(most).collect()}
    strata, total = by_size.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    own, all_pooled, part = families(sizes, alpha, delta, total - sum(sizes.values()))
    n_of = {f"={x}": sizes[x] for x in own}
    if strata > len(own):
        n_of["*"] = total if all_pooled else total - sum(n_of.values())
    alone = F.col("_stratum").isin(own)
    pooled = F.when(F.lit(all_pooled) | ~alone, F.lit("*"))
    tests = F.array_compact(F.array(F.when(alone, F.concat(F.lit("="), "_stratum")), pooled))
    tested = rows.withColumn("_test", F.explode(tests))
    accepted: dict[tuple[str, str], float] = {}
    of_pool: dict[str, list[float]] = {}
    failed = set()
    cutoffs = {}
    starts = 1
    sums = []
    for k, cs in CUTOFFS.items():
        before = _failed_score(accepted, "_test").isNotNull()
        hits = [F.sum((before | (scores()[k] > c)).cast("long")).alias(f"_{i}") for i, c in enumerate(cs)]
        counts = {r["_test"]: r for r in tested.groupBy("_test").agg(*hits).collect()}
        for test, n in n_of.items():
            level = part / 2 / ((len(CUTOFFS) - 1) * starts if test in failed else 1)
            for i, c in enumerate(cs):
                if binomial_cdf(counts[test][f"_{i}"], n, alpha) > level:
                    failed.add(test)
                    break
                accepted[test, k] = c
                if test == "*":
                    of_pool.setdefault(k, []).append(c)
                    sums.append(hits[i].alias(f"_{k}_{i}"))
                else:
                    cutoffs[test[1:], k] = c
        starts *= len(cs) + 1
    if not of_pool:
        drop_stored(rows, by_size)
        return Cutoffs(cutoffs, own, None)
    fields = ", ".join(f"_cut_{k} double" for k in CUTOFFS)
    small = tested.filter("_test = '*'").filter(~alone).groupBy("_stratum").agg(F.count(F.lit(1)), *sums)
    small = stored(small.mapInArrow(_milder(of_pool, alpha, delta), f"_of string, _labels long, {fields}"), "cutoffs")
    top = small.orderBy(F.desc("_labels"), "_of").limit(most).collect()
    for r in top:
        cutoffs.update({(r["_of"], k): r[f"_cut_{k}"] for k in CUTOFFS if r[f"_cut_{k}"] is not None})
    known = [*own, *(r["_of"] for r in top)]
    drop_stored(rows, by_size)
    return Cutoffs(cutoffs, known, small if strata > len(known) else None)


def _failed_score(cutoffs: dict[tuple[str, str], float], stratum: str) -> F.Column:
    """The first score above its stratum's cutoff, or null."""
    failed = F.lit(None).cast("string")
    s = scores()
    for k in reversed(CUTOFFS):
        by = {a: c for (a, b), c in cutoffs.items() if b == k}
        if by:
            cut = F.create_map(*[F.lit(x) for kv in by.items() for x in kv])[F.col(stratum)]
            failed = F.when(s[k] > cut, F.lit(k)).otherwise(failed)
    return failed


def _judged(measured: DataFrame, cutoffs: Cutoffs, stratum: str, salts: int = 16) -> DataFrame:
    """measured with `_failed_score`. Rows of strata that aren't known to the driver join their cutoffs, spread by a salt."""
    out = measured.withColumn("_failed_score", _failed_score(cutoffs.of, stratum))
    if cutoffs.rest is None:
        return out
    known = F.col(stratum).isin(cutoffs.known)
    others = measured.filter(~known).withColumn("_salt", (F.monotonically_increasing_id() % salts).cast("int"))
    rest = cutoffs.rest.withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts))))).withColumnRenamed("_salt", "_salted")
    others = others.join(rest, (F.col(stratum) == F.col("_of")) & (F.col("_salt") == F.col("_salted")), "left")
    failed = F.lit(None).cast("string")
    for k in reversed(CUTOFFS):
        failed = F.when(scores()[k] > F.col(f"_cut_{k}"), F.lit(k)).otherwise(failed)
    return out.filter(known).unionByName(others.withColumn("_failed_score", failed).select(out.columns))


def _stratum(name: str) -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("none"))


def quality_rules(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", alpha: float = 0.004, delta: float = 0.05, most: int = 256, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, BASE, base_failed, kept, stratum, failed_score.

    kept is false if base_failed or if a score is above its stratum's guaranteed cutoff; failed_score
    names the first such score. Null and empty texts have no words and fail the base rule. A null
    stratum is the stratum 'none'. Strata may be as many as they like; the `most` with the most labels are tested on their own at best. Without labels (an empty table, or too few for any guarantee)
    only the base rules reject; a stratum without a labelled good document has no cutoff. Repeated rows and ids are judged each on its own. A label without
    a document, or with null quality, counts for nothing. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), _stratum(stratum).alias("stratum"), F.col(text).alias("text"))
    measured = stored(measure(rows, keep=("doc_id", "stratum")), "quality")
    cutoffs = calibrate(measured, labels, "stratum", alpha, delta, most)
    out = _judged(measured, cutoffs, "stratum").withColumn("base_failed", base_failed())
    failed = F.col("_failed_score")
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & failed.isNull()).alias("kept"), "stratum", failed.alias("failed_score"))


def keep_good(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", alpha: float = 0.004, delta: float = 0.05, most: int = 256, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, whole, that quality_rules() keeps. Each row is judged by its own text, so no join by id is needed.

    Texts are measured once: the rows are written with their measures, which the calibration reads alone.
    """
    names = [f"_in_{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in (text, id_col)}
    rows = docs.select(_stratum(stratum).alias("_s"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    rows = rows.withColumn("_t", F.col(at[text]))
    measured = stored(measure(rows, "_t", ("_s", *names)), "measured")
    cutoffs = calibrate(measured, labels, "_s", alpha, delta, most, at[id_col])
    kept = _judged(measured, cutoffs, "_s").filter(~base_failed() & F.col("_failed_score").isNull())
    return kept.select(*names).toDF(*docs.columns)
