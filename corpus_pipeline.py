"""The corpus pipeline: from documents to packed sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import Leftovers, drop_stored, stored
from skarn.llm.exact_dedup import drop_copies
from skarn.llm.ngram_join import drop_similar
from skarn.llm.packing import pack
from skarn.llm.quality import keep_good
from skarn.llm.queries import vocabulary_path
from skarn.llm.substring_dedup import cut_passages, repeated_passages

_left = Leftovers()

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tidy(stage: Stage) -> Stage:
    """The stage, which first deletes the tables that earlier stages stored on the way and that its docs don't read."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return _left.step(lambda: stage(spark, docs, sf_dir), docs)

    return run


@_tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a guaranteed cutoff go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_tidy
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest id stays."""
    return drop_copies(docs)


@_tidy
def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity, the smallest id stays."""
    return drop_similar(docs)


@_tidy
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too are cut; a document without a word left goes. n_chars follows the text."""
    out = cut_passages(docs, repeated_passages(docs))
    if "n_chars" not in docs.columns:
        return out
    changed = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(docs.columns)


@_tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of 2048 tokens."""
    return pack(docs, vocabulary_path())


STAGES = [("quality", quality), ("exact_dedup", exact), ("ngram_join", similar), ("substring_dedup", passages), ("packing", packed)]

#: The n-gram join's components, the alignments and the packing can't be expressed in SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_stored(before)
        before = docs
    return docs
