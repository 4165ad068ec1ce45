"""Documents from tables: overlapping chunks for retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import chunks


def chunk_documents(docs: DataFrame, size: int, overlap: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, chunk_no and chunk: pieces of `size` characters that overlap, trimmed, without blank ones."""
    rows = docs.select(F.col(id_col), F.posexplode(chunks(F.coalesce(F.col(text), F.lit("")), size, overlap)).alias("chunk_no", "chunk"))
    return rows
