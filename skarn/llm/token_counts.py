"""Token counts by a two-tier lookup on the map side: no pre-token is shuffled."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.bpe import codec, each_text, vocabulary


def pack_table(table: dict[str, int]) -> tuple[bytes, bytes]:
    """The words, each ended by a line feed (no word has one), and their lengths as 16-bit integers."""
    return "\n".join(table).encode(), np.fromiter(table.values(), "<u2", len(table)).tobytes()


def unpack_table(packed: tuple[bytes, bytes]) -> dict[str, int]:
    words = packed[0].decode().split("\n") if packed[1] else []
    return dict(zip(words, np.frombuffer(packed[1], "<u2").tolist()))


def _words(source: Broadcast, most: int):
    """The most frequent of the words that a task's rows have twice or more, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(source.value)
        seen: Counter = Counter()
        for batch in batches:
            for text in each_text(batch):
                seen.update(w for w in c.words(text) if len(w) <= 48 and "\n" not in w)
        top = [(w, n) for w, n in seen.most_common(most) if n > 1]
        if top:
            words, n = zip(*top)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    return run


def frequent(docs: DataFrame, source: Broadcast, sample: int = 2048, most: int = 65_536, text: str = "text") -> dict[str, int]:
    """Token counts of the `most` most frequent words of a random sample of about `sample` rows.

    A task that has rows of the sample sends to the driver the words that they have twice or more, with their numbers: at most
    16,384 of them, so at most 16,384 x sample pairs arrive, however large the table, and nothing is shuffled. The
    table only saves work: no count depends on it.
    """
    total = docs.count()
    rows = docs.select(F.col(text).cast("string").alias("text"))
    rows = rows.filter(F.rand(7) < sample / total) if total > sample else rows
    got = rows.mapInArrow(_words(source, 16_384), "word string, n long").toArrow()
    top = got.group_by("word").aggregate([("n", "sum")]).sort_by([("n_sum", "descending"), ("word", "ascending")]).slice(0, most)
    encode = codec(source.value).counts.encode
    return {w: encode(" " + w) for w in top.column("word").to_pylist()}


def _count(source: Broadcast, table: Broadcast, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(source.value)
        if c.tier is not table.value:
            c.tier = table.value
            c.counts.give(unpack_table(table.value))  # the first tier; misses fill the worker's own cache
        for batch in batches:
            n = [c.count(t) for t in each_text(batch)]
            over = [x > limit for x in n]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(over, pa.bool_())], names=[*batch.schema.names[1:], "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", id_col: str = "doc_id", sample: int = 2048, most: int = 65_536) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A table of frequent words with their token counts (frequent(): at most `most` words of up to 48 characters, from about
    `sample` rows) is broadcast and stays in each worker; other words are encoded once and kept in the worker's bounded
    cache. A null or empty text has no bytes and no tokens. Repeated rows and null ids are rows like others; other
    columns are not read.
    """
    spark = docs.sparkSession
    source = vocabulary(spark, path)
    table = spark.sparkContext.broadcast(pack_table(frequent(docs, source, sample, most, text)))
    t = F.col(text).cast("string")
    rows = docs.select(t.alias("_text"), F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("n_bytes"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_count(source, table, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
