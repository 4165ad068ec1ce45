"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import HOT_PARTS, drop_stored, partitions, stored

LETTERS = 128
CELLS = 3 << 20


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """A symbol for each code point: 0 for what is no letter, one each for those of Latin-1, 68 for all others."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            out[cp] = cp - 96 if 97 <= cp <= 122 else cp - 0xDF + 27 if 0xDF <= cp <= 0xFF else 60 + ((cp * 2654435761) >> 16) % 68
    return out


class Space:
    """Random letter vectors of `dim` signs. The vector of letters a, b, c binds (multiplies) a permuted twice, b permuted once, and c."""

    def __init__(self, dim: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        letters = rng.choice(np.array([-1, 1], np.int8), (LETTERS, dim))
        order = rng.permutation(dim)
        self.dim = dim
        self.first, self.second, self.third = letters[:, order][:, order], letters[:, order], letters
        self.place = np.zeros(LETTERS**3, np.int32)

    def ngrams(self, codes: np.ndarray) -> np.ndarray:
        v = self.first[codes >> 14] * self.second[(codes >> 7) & 127]
        v *= self.third[codes & 127]
        return v.astype(np.float32)

    def bundle(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The bundles (sums of n-gram vectors) of texts, some at a time, and whether each text has a letter."""
        table = _symbols()
        i = 0
        while i < len(texts):
            lowered, size = [], 0
            while i < len(texts) and size < 400_000 and len(lowered) < 256:
                lowered.append(f" {texts[i].lower()} ")
                size += len(lowered[-1])
                i += 1
            cp = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
            doc = np.repeat(np.arange(len(lowered)), [len(t) for t in lowered])
            s = table[cp]
            letters = np.bincount(doc, s > 0, len(lowered)) > 0
            keep = np.ones(len(s), bool)
            keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (doc[1:] != doc[:-1])
            s, doc = s[keep].astype(np.int32), doc[keep]
            code = s[:-2] << 14 | s[1:-1] << 7 | s[2:] if len(s) > 2 else np.zeros(0, np.int32)
            same = doc[:-2] == doc[2:] if len(s) > 2 else np.zeros(0, bool)
            code, doc = code[same], doc[:-2][same] if len(s) > 2 else doc[:0]
            present = np.flatnonzero(np.bincount(code, minlength=LETTERS**3))
            self.place[present] = np.arange(len(present))
            counts = np.bincount(doc * len(present) + self.place[code], minlength=len(lowered) * len(present))
            out = np.zeros((len(lowered), self.dim), np.float32)
            counts = counts.reshape(len(lowered), -1).astype(np.float32)
            for a in range(0, len(present), 4096):  # blocks bound the memory of n-gram vectors
                out += counts[:, a : a + 4096] @ self.ngrams(present[a : a + 4096])
            yield out, letters


@lru_cache(maxsize=2)
def _space(dim: int) -> Space:
    return Space(dim)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)


def _learn(dim: int, most: int = 512):
    """Sums of the unit bundles by language, at most `most` languages at a time."""

    def out(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, at = batch.column(1).to_pylist(), 0
            for v, letters in _space(dim).bundle([t or "" for t in batch.column(0).to_pylist()]):
                v = _unit(v) * letters[:, None]
                for lang, x in zip(langs[at : at + len(v)], v):
                    sums[lang] = sums.get(lang, 0) + x.astype(np.float64)
                at += len(v)
            if len(sums) > most:
                yield out(sums)
                sums = {}
        if sums:
            yield out(sums)

    return run


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by language: the unit mean of each language that has a letter."""
    now, total = None, None
    for batch in batches:
        done: list[tuple[str, bytes]] = []
        for lang, v in zip(*(c.to_pylist() for c in batch.columns)):
            if lang != now:
                if now is not None and np.any(total):
                    done.append((now, _unit(total).tobytes()))
                now, total = lang, 0
            total = total + np.frombuffer(v)
        yield _named(done)
    if now is not None and np.any(total):
        yield _named([(now, _unit(total).tobytes())])


def _named(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    lang, v = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(v, pa.binary())], names=["lang", "vector"])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, 0
    for batch in batches:
        for v in batch.column(0).to_pylist():
            n, total = n + 1, total + np.frombuffer(v)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "vector"])


def _predict(model: Model, dim: int):
    def held(block: Broadcast) -> tuple[list[str], np.ndarray]:
        value = block.value
        if len(model.blocks) > 16:
            del block._value  # a worker holds one block of many at a time
        return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred: list[str] = []
            score: list[float] = []
            for i in range(0, batch.num_rows, 2048):
                texts = [t or "" for t in batch.column(0).slice(i, 2048).to_pylist()]
                for v, letters in _space(dim).bundle(texts):
                    x = _unit(_unit(v) - model.centre) if model.blocks else v
                    name, top = ["und"] * len(v), np.full(len(v), -np.inf, np.float32)
                    for block in model.blocks:
                        langs, prototypes = held(block)
                        cos = x @ prototypes.T
                        best, most = cos.argmax(axis=1).tolist(), cos.max(axis=1)
                        for r in np.flatnonzero(letters & (most >= top)).tolist():
                            if most[r] > top[r] or langs[best[r]] < name[r]:
                                name[r] = langs[best[r]]
                        top = np.maximum(top, most)
                    pred += name
                    score += np.where(letters & (top > 0), np.minimum(top, 1), 0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[1:], "lang_pred", "score"])

    return run


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _picked(docs: DataFrame, sample: int, text: str, lang: str, id_col: str) -> DataFrame:
    """About `sample` labelled rows of each language, those with the smallest hashes of their ids (all, where there are fewer).

    At most HOT_PARTS languages have more than their even part of all labelled rows; their counts are collected. The
    rows of all others, of which none is hot, join their counts.
    """
    rows = docs.filter(~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)).alias("_hash"))
    sizes = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "languages")
    total, languages = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    hot = {r.lang: r["_n"] for r in sizes.filter(F.col("_n") > max(sample, total // HOT_PARTS)).collect()}
    picked = []
    if hot:
        share = F.create_map(*[F.lit(x) for k, n in hot.items() for x in (k, -(-(1 << 20) * sample // n))])
        picked.append(rows.filter(F.col("_hash") < share[F.col("lang")]))
    if languages > len(hot) or not hot:
        rest = sizes.join(rows.filter(~F.col("lang").isin(list(hot))) if hot else rows, "lang")
        picked.append(rest.filter(F.col("_hash") < F.ceil(F.lit(float((1 << 20) * sample)) / F.greatest("_n", F.lit(sample)))))
    picked = [p.select("text", "lang") for p in picked]
    return picked[0].unionAll(picked[1]) if len(picked) == 2 else picked[0]


class Model(NamedTuple):
    """The prototypes, in blocks of a bounded number of languages, and the centre they are taken from."""

    blocks: list[Broadcast]
    centre: np.ndarray


def language_model(docs: DataFrame, sample: int = 3000, dim: int = 1024, block: int = 512, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> Model:
    """Prototypes of all languages and their centre, learned from rows with an id that isn't held out.

    The classifier is fitted on about `sample` labelled rows of each language (_picked()). The languages may be as many as
    they like: their sums are joined by key, and prototypes pass the driver `block` languages (4 kB each) at a time.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    picked = _picked(docs, sample, text, lang, id_col).repartition(parts)
    sums = picked.mapInArrow(_learn(dim), "lang string, vector binary").repartition(parts, "lang").sortWithinPartitions("lang")
    means = stored(sums.mapInArrow(_means, "lang string, vector binary"), "prototypes")
    totals = means.select("vector").mapInArrow(_total, "n long, vector binary").collect()
    n = sum(r.n for r in totals)
    centre = sum(np.frombuffer(r.vector) for r in totals) / n if n > 1 else np.zeros(dim)
    count = -(-n // block)
    blocks = []
    for b in range(count):
        rows = sorted(means.filter(F.pmod(F.xxhash64("lang"), F.lit(count)) == b).collect())
        if rows:
            prototypes = _unit(np.stack([np.frombuffer(r.vector) for r in rows]) - centre).astype(np.float32)
            blocks.append(spark.sparkContext.broadcast(([r.lang for r in rows], prototypes)))
    drop_stored(means)
    return Model(blocks, centre.astype(np.float32))


def language_id(docs: DataFrame, sample: int = 3000, dim: int = 1024, block: int = 512, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Letters outside runs count as one space. A document's bundle and the prototypes, less their common
    centre, are compared by cosine; score is the largest, 0 at least. Equal cosines go to the first
    language by name. A text that is null, empty or without a letter is `und` with score 0, and so is
    every text where no labelled row with a letter is left to learn from. Any number of languages is learned, rare ones
    from the rows they have. Rows with a null id are not held
    out, and nothing is learned from them. Whole texts are used, whatever their length; repeated rows are judged each. Other columns are not read.
    """
    model = language_model(docs, sample, dim, block, text, lang, id_col)
    rows = docs.select(F.col(text).cast("string").alias("_text"), F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_predict(model, dim), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
