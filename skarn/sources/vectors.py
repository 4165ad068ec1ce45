"""Vector files: .fvecs, .ivecs, .fbin, .ibin and .npy, read in ranges by many tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK = 10_000


def _layout(path: str) -> tuple[int, int, int, int, np.dtype, bool]:
    """Rows, dimensions, header bytes, bytes a row, element type, and whether each row begins with its length."""
    kind = os.path.splitext(path)[1]
    size = os.path.getsize(path)
    if kind in (".fvecs", ".ivecs"):
        if not size:
            return 0, 0, 0, 4, np.dtype("<f4"), True
        dim = int(np.fromfile(path, "<i4", 1)[0])
        row = 4 + 4 * dim
        if size % row:
            raise ValueError(f"{path} has a broken row")
        return size // row, dim, 0, row, np.dtype("<f4" if kind == ".fvecs" else "<i4"), True
    if kind in (".fbin", ".ibin"):
        n, dim = (int(x) for x in np.fromfile(path, "<u4", 2))
        return n, dim, 8, 4 * dim, np.dtype("<f4" if kind == ".fbin" else "<i4"), False
    if kind == ".npy":
        a = np.load(path, mmap_mode="r")
        return a.shape[0], a.shape[1], a.offset, a.shape[1] * a.itemsize, a.dtype, False
    raise ValueError(f"unknown vector file: {path}")


def read_vectors(spark: SparkSession, path: str, first: int = 0, limit: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """vec_id and embedding (array of float, or of int in .ivecs and .ibin). Each task reads ranges of `chunk` rows.

    The file must lie on a file system that all executors mount.
    """
    n, dim, head, row, kind, lengths = _layout(path)
    end = n if limit is None else min(n, first + limit)
    starts = list(range(first, end, chunk))
    element = "float" if kind.kind == "f" else "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    m = min(chunk, end - at)
                    f.seek(head + at * row)
                    raw = np.frombuffer(f.read(m * row), np.uint8).reshape(m, row)
                    x = np.ascontiguousarray(raw[:, 4:] if lengths else raw).view(kind).reshape(m, dim)
                    flat = pa.array(x.ravel().astype(np.float32 if element == "float" else np.int32))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m * dim + 1, dim, dtype=np.int32) if dim else np.zeros(m + 1, np.int32)), flat)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + m)), lists], names=["vec_id", "embedding"])

    schema = f"vec_id long, embedding array<{element}>"
    if not starts:
        return spark.createDataFrame([], schema)
    ranges = spark.createDataFrame([(s,) for s in starts], "at long").repartition(min(len(starts), 4096))
    return ranges.mapInArrow(run, schema)


def write_vectors(x: np.ndarray, path: str) -> None:
    """Write a matrix in the format of the path's ending."""
    kind = os.path.splitext(path)[1]
    if kind == ".npy":
        np.save(path, x)
        return
    t = "<f4" if kind in (".fvecs", ".fbin") else "<i4"
    with open(path, "wb") as f:
        if kind in (".fbin", ".ibin"):
            np.array(x.shape, "<u4").tofile(f)
            x.astype(t).tofile(f)
        else:
            rows = np.empty((len(x), x.shape[1] + 1), t)
            rows[:, 1:] = x
            rows[:, :1].view("<i4")[:] = x.shape[1]
            rows.tofile(f)


def read_filtered_benchmark(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vectors.npy, payloads.jsonl and tests.jsonl of a folder: vectors, payloads with their row number, and tests."""
    from pyspark.sql import functions as F

    def lines(name: str, key: str) -> DataFrame:
        text = spark.read.text(os.path.join(folder, name), wholetext=False)
        rows = text.select(F.col("value").alias("json"), F.monotonically_increasing_id().alias("_at"), F.spark_partition_id().alias("_p"))
        counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect()
        shift, total = [], 0
        for r in counts:
            shift.append((r["_p"], total))
            total += r.n
        if not shift:
            return rows.select(F.col("_at").alias(key), "json")
        first = spark.createDataFrame(shift, "_p int, _first long")
        return rows.join(F.broadcast(first), "_p").select((F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(key), "json")

    return read_vectors(spark, os.path.join(folder, "vectors.npy")), lines("payloads.jsonl", "vec_id"), lines("tests.jsonl", "test_id")
