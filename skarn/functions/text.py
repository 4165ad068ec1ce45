"""Text analysis: tokens as a column."""

from __future__ import annotations

from collections.abc import Iterator
from enum import Enum

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


class Analyzer(Enum):
    STANDARD = "standard"
    WHITESPACE = "whitespace"
    NONE = "none"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exploded(docs: DataFrame, id_col: str, text_col: str, analyzer: Analyzer | str = Analyzer.STANDARD) -> DataFrame:
    """doc_id and term, a row for each of tokens(). Stop words are dropped as rows, in generated code.

    The explode is an outer one: from an inner one the planner infers a filter that splits every text twice.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    if Analyzer(analyzer) is Analyzer.STANDARD:
        rows = docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(F.split(lower_ascii(text), "[^a-z0-9]+")).alias("term"))
        return rows.filter((F.length("term") >= 2) & ~F.col("term").isin(STOP_WORDS))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(tokens(text, analyzer)).alias("term")).filter("term is not null")


def tokens(text: Column, analyzer: Analyzer | str = Analyzer.STANDARD) -> Column:
    """The terms of a text, in order and with repeats.

    STANDARD splits at all but ASCII letters and digits, and drops stop words. WHITESPACE splits at ASCII
    white space, NONE doesn't split; both then strip all but ASCII letters and digits. Terms are in
    lower case and have two characters or more. A null text has none.
    """
    analyzer = Analyzer(analyzer)
    text = F.coalesce(text, F.lit(""))
    if analyzer is Analyzer.STANDARD:  # by regular expressions: a lambda over the terms is many times slower
        words = F.regexp_replace(lower_ascii(text), "[^a-z0-9]+", " ")
        words = F.regexp_replace(words, rf"(?<![a-z0-9])(?:[a-z0-9]|{'|'.join(STOP_WORDS)})(?![a-z0-9])", "")
        return F.array_remove(F.split(words, " +"), "")
    parts = F.split(text, r"[ \t\n\x0B\f\r]+") if analyzer is Analyzer.WHITESPACE else F.array(text)
    parts = F.transform(parts, lambda t: F.lower(F.regexp_replace(t, "[^A-Za-z0-9]", "")))
    return F.filter(parts, lambda t: F.length(t) >= 2)


#: The lower case of ASCII letters and digits, 0 for all other bytes.
_FOLD = np.array([b if chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0 for b in range(128)] + [0] * 128, np.uint8)


def _term_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The STANDARD terms of a batch of texts: a row and a code for each, and the terms that codes stand for."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pa.concat_arrays([texts])  # offsets from the buffers' start, also of a slice
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = _FOLD[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = raw != 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < len(raw)]
    opens[first] = inside[first]  # a text ends a term
    start = np.flatnonzero(opens)
    size = np.add.reduceat(inside, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
    kept = np.repeat(size >= 2, size)
    chars = raw[inside][kept]
    start, size = start[size >= 2], size[size >= 2]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(chars)]).dictionary_encode()
    codes, words = terms.indices.to_numpy(), terms.dictionary
    good = ~np.isin(codes, np.flatnonzero(pc.is_in(words, pa.array(STOP_WORDS, pa.large_string())).to_numpy(zero_copy_only=False)))
    return np.searchsorted(at, start[good], "right") - 1, codes[good], words


def counted(docs: DataFrame, id_col: str, text_col: str, lengths: bool = False) -> DataFrame:
    """term, doc_id, tf and doc_len of each row's STANDARD terms, counted row by row with no shuffle; with lengths, doc_id and doc_len only. Rows without terms give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in [batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)]:
                row, code, words = _term_batch(some.column(1))
                size, ids = np.bincount(row, minlength=some.num_rows), some.column(0)
                if lengths:
                    there = np.flatnonzero(size)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(there)), pa.array(size[there])], names=["doc_id", "doc_len"])
                    continue
                pairs, tf = np.unique(row * max(1, len(words)) + code, return_counts=True)
                row, code = np.divmod(pairs, max(1, len(words)))
                yield pa.RecordBatch.from_arrays([words.take(pa.array(code)).cast(pa.string()), ids.take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(size[row])], names=["term", "doc_id", "tf", "doc_len"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, doc_len long" if lengths else "term string, doc_id long, tf int, doc_len long")


def snippet(content: Column, query_words: list[str], max_len: int = 150) -> Column:
    """The first window of max_len // 5 words with most query words, with ... where words are left out."""
    n = max_len // 5
    words = F.filter(F.split(content, r"\s+"), lambda w: w != "")
    want = F.array(*[F.lit(w) for w in sorted({w.lower() for w in query_words})]) if query_words else F.array().cast("array<string>")
    hits = F.transform(words, lambda w: F.array_contains(want, F.btrim(F.lower(w), F.lit(".,!?"))).cast("int"))
    scores = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.aggregate(F.slice(hits, i + 1, n), F.lit(0), lambda s, x: s + x))
    at = F.array_position(scores, F.array_max(scores)).cast("int") - 1
    text = F.array_join(F.slice(words, at + 1, n), " ")
    text = F.concat(F.when(at > 0, "...").otherwise(""), text, F.when(at + n < F.size(words), "...").otherwise(""))
    return F.when(F.size(words) <= n, content).otherwise(text)


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Overlapping pieces of `size` characters, trimmed; blank ones are left out."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
    pieces = F.transform(starts, lambda i: F.regexp_replace(F.substring(text, i + 1, F.lit(size)), r"^\s+|\s+$", ""))
    return F.when(F.length(text) > 0, F.filter(pieces, lambda p: p != "")).otherwise(F.array().cast("array<string>"))
