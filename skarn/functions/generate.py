"""Deterministic test data on the executors: FNV-1a hashes, and Zipf numbers plain and scrambled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(1099511628211)


def fnv1a(values: np.ndarray) -> np.ndarray:
    """The 64-bit FNV-1a hash of the 8 little-endian bytes of each value."""
    h, v = np.full(len(values), OFFSET, np.uint64), np.asarray(values).astype(np.uint64)
    for i in range(8):
        h = (h ^ ((v >> np.uint64(8 * i)) & np.uint64(0xFF))) * PRIME
    return h


def zipf(u: np.ndarray, n: int, theta: float) -> np.ndarray:
    """Numbers 1..n of a Zipf distribution for uniform u in [0, 1)."""
    if n < 1:
        return np.zeros(len(u), np.int64)
    zeta = lambda m: float(np.sum(np.arange(1, m + 1) ** -theta))
    total, alpha = zeta(n), 1 / (1 - theta)
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - zeta(2) / total) if n > 2 else 1.0
    tail = np.minimum(n, 1 + (n * np.maximum(eta * u - eta + 1, 0) ** alpha).astype(np.int64))
    return np.where(u * total < 1, 1, np.where(u * total < 1 + 0.5**theta, min(2, n), tail)).astype(np.int64)


def zipf_column(uniform: Column, n: int, theta: float = 0.99, low: int | None = None) -> Column:
    """Zipf numbers for a column of uniform numbers; with low, scrambled over low .. low + n - 1."""

    @F.pandas_udf("long")
    def draw(u: pd.Series) -> pd.Series:
        z = zipf(u.to_numpy(), n if low is None else 2 * n, theta)
        return pd.Series(z if low is None else low + (fnv1a(z) % np.uint64(n)).astype(np.int64))

    return draw(uniform)
