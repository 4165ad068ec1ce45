"""Fusion of a vector and a text ranking, and re-ranking of results."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class FusionMethod(Enum):
    RRF = "rrf"
    WEIGHTED = "weighted"


@dataclass
class FusionParams:
    method: FusionMethod = FusionMethod.RRF
    rrf_k: int = 60
    vector_weight: float = 0.5
    text_weight: float = 0.5
    normalize: bool = True
    strict: bool = False


def _top(df: DataFrame, k: int) -> DataFrame:
    out = df.orderBy(F.desc("score"), "doc_id").limit(k)
    return out.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score", "vector_score", "text_score")


def _sides(vector: DataFrame, text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lists with rank from 1. They are a search's top 2k, so one task can rank them."""
    v = vector.select("doc_id", F.col("distance").alias("vector_score"), F.row_number().over(Window.orderBy("distance", "doc_id")).alias("_vr"))
    t = text.select("doc_id", F.col("score").alias("text_score"), F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("_tr"))
    return v, t


def rrf(vector: DataFrame, text: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (doc_id, distance) and (doc_id, score): rank, doc_id, score, vector_score, text_score."""
    v, t = _sides(vector, text)
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col(r)), F.lit(0.0))
    both = v.join(t, "doc_id", "full_outer").withColumn("score", part("_vr") + part("_tr"))
    return _top(both.fillna(0.0, ["vector_score", "text_score"]), k)


def weighted(vector: DataFrame, text: DataFrame, k: int, vector_weight: float = 0.5, text_weight: float = 0.5, normalize: bool = True, strict: bool = False) -> DataFrame:
    """Weighted sum of both lists' scores, each scaled to 0..1 within its list (0.5 where all are equal).

    A document that a list lacks gets 0 from it. The nearest vector scores 1; with strict, it scores 0: the
    scaled distance itself is the score.
    """
    total = vector_weight + text_weight
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    v, t = _sides(vector, text)

    def scaled(c: str) -> F.Column:
        low, high = F.min(c).over(Window.partitionBy(F.lit(0))), F.max(c).over(Window.partitionBy(F.lit(0)))
        return F.when(high - low < 1e-9, F.lit(0.5)).otherwise((F.col(c) - low) / (high - low))

    vs = scaled("vector_score") if normalize else F.col("vector_score")
    if normalize and not strict:
        vs = F.lit(1.0) - vs
    v = v.withColumn("_v", vs)
    t = t.withColumn("_t", scaled("text_score") if normalize else F.col("text_score"))
    both = v.join(t, "doc_id", "full_outer").fillna(0.0, ["_v", "_t", "vector_score", "text_score"])
    return _top(both.withColumn("score", F.col("_v") * (vector_weight / total) + F.col("_t") * (text_weight / total)), k)


def fuse(vector: DataFrame, text: DataFrame, k: int, params: FusionParams | None = None) -> DataFrame:
    p = params or FusionParams()
    if p.method is FusionMethod.RRF:
        return rrf(vector, text, k, p.rrf_k)
    return weighted(vector, text, k, p.vector_weight, p.text_weight, p.normalize, p.strict)


def rerank_recency(results: DataFrame, k: int, weight: float, now: float, timestamp: str = "timestamp", id_col: str = "doc_id") -> DataFrame:
    """final_score = (1 - weight) x score + weight x exp(-age in hours / 24); a missing time counts as now."""
    age = (F.lit(now) - F.coalesce(F.col(timestamp).cast("double"), F.lit(now))) / 3600
    return results.withColumn("final_score", (1 - weight) * F.col("score") + weight * F.exp(-age / 24)).orderBy(F.desc("final_score"), id_col).limit(k)


def rerank_popularity(results: DataFrame, k: int, boost: float, popularity: str = "popularity", id_col: str = "doc_id") -> DataFrame:
    """final_score = (1 - boost) x score + boost x popularity; a missing popularity is 0."""
    pop = F.coalesce(F.col(popularity).cast("double"), F.lit(0.0))
    return results.withColumn("final_score", (1 - boost) * F.col("score") + boost * pop).orderBy(F.desc("final_score"), id_col).limit(k)


def excluding(results: DataFrame, ids: list, k: int, id_col: str = "doc_id") -> DataFrame:
    """The best k of an over-fetched list, without given ids."""
    rows = results.filter(~F.col(id_col).isin(list(ids))) if ids else results
    return rows.orderBy("rank").limit(k)


def pack_context(results: DataFrame, max_tokens: int = 2000, text: str = "content", source: str = "source") -> DataFrame:
    """The results, by rank, as long as their words add up to max_tokens; the first that goes beyond ends the list.

    Results without a word are left out. Each other one has a word at least, so only the first max_tokens of the list can be meant, and no task sees more.
    """
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""))
    running = F.sum("n_words").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    first = results.withColumn("n_words", words).filter("n_words > 0").orderBy("rank").limit(max_tokens)
    kept = first.withColumn("total_words", running).filter(F.col("total_words") <= max_tokens)
    return kept.withColumn("part", F.concat(F.lit("[Source: "), F.coalesce(F.col(source), F.lit("unknown")), F.lit("]\n"), F.col(text)))


def context_text(packed: DataFrame) -> DataFrame:
    """One row: the parts of pack_context() in one text."""
    parts = F.sort_array(F.collect_list(F.struct("rank", "part")))
    return packed.agg(F.array_join(parts["part"], "\n\n---\n\n").alias("context"))
