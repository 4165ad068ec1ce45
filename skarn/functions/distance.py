"""Distances of vectors: as columns of array<float>, and as numpy kernels for blocks."""

from __future__ import annotations

from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


class DistanceMetric(Enum):
    L2 = "l2"
    INNER_PRODUCT = "ip"
    COSINE = "cosine"

    @classmethod
    def parse(cls, value: DistanceMetric | str) -> DistanceMetric:
        if isinstance(value, cls):
            return value
        names = {"l2": cls.L2, "fast_l2": cls.L2, "ip": cls.INNER_PRODUCT, "inner_product": cls.INNER_PRODUCT, "cosine": cls.COSINE}
        if str(value).lower() not in names:
            raise ValueError(f"unknown metric: {value}")
        return names[str(value).lower()]


def _vector(v: Column | list[float] | np.ndarray) -> Column:
    return v if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v])


def _total(a: Column, b: Column, f) -> Column:
    terms = F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column | list[float], b: Column | list[float]) -> Column:
    """The sum of squared differences, without a root."""
    return _total(_vector(a), _vector(b), lambda x, y: (x - y) * (x - y))


def inner_product(a: Column | list[float], b: Column | list[float]) -> Column:
    return _total(_vector(a), _vector(b), lambda x, y: x * y)


def ip_distance(a: Column | list[float], b: Column | list[float]) -> Column:
    return F.lit(1.0) - inner_product(a, b)


def cosine_distance(a: Column | list[float], b: Column | list[float]) -> Column:
    """1 - cosine, between 0 and 2. Where the norms' product is below 1e-10, 1."""
    x, y = _vector(a), _vector(b)
    norms = F.sqrt(inner_product(x, x) * inner_product(y, y))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(x, y) / norms))
    return F.when(norms < TINY, F.lit(1.0)).otherwise(F.lit(1.0) - cos)


def distance(metric: DistanceMetric | str, a: Column | list[float], b: Column | list[float]) -> Column:
    return {DistanceMetric.L2: l2_squared, DistanceMetric.INNER_PRODUCT: ip_distance, DistanceMetric.COSINE: cosine_distance}[DistanceMetric.parse(metric)](a, b)


def normalised(v: Column) -> Column:
    """The vector by its length; a zero vector stays."""
    norm = F.sqrt(inner_product(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def sub_vector(v: Column, m: int, width: int) -> Column:
    """The m-th slice of `width` elements, from 0."""
    return F.slice(v, m * width + 1, width)


def block(metric: DistanceMetric | str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All distances of two blocks of vectors, by one matrix product. Rounded to 1e-12, so that equal vectors tie."""
    metric = DistanceMetric.parse(metric)
    q, v = np.asarray(queries, np.float64), np.asarray(rows, np.float64)
    dots = q @ v.T
    if metric is DistanceMetric.INNER_PRODUCT:
        out = 1.0 - dots
    else:
        qq, vv = np.einsum("ij,ij->i", q, q)[:, None], np.einsum("ij,ij->i", v, v)[None, :]
        if metric is DistanceMetric.L2:
            out = np.maximum(qq + vv - 2.0 * dots, 0.0)
        else:
            norms = np.sqrt(qq * vv)
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.where(norms < TINY, 1.0, 1.0 - np.clip(dots / norms, -1.0, 1.0))
    return np.round(out, 12) + 0.0
