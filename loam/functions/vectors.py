"""Vector expressions: cosine, half precision, random hyperplanes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ty

PLANES, SEED = 14, 5134245


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of the two."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero if either vector has no length."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    product = norm(a) * norm(b)
    return F.when(product == 0, 0.0).otherwise(F.try_divide(dot(a, b), product))


def hyperplanes(dimension: int, planes: int = PLANES, seed: int = SEED) -> np.ndarray:
    p = np.random.default_rng(seed).uniform(-1, 1, (planes, dimension))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def signature(v: Column, planes: np.ndarray) -> Column:
    """Bit i is set if the product with plane i isn't negative; the zero vector has all bits, null has none. Whole batches are multiplied at once."""
    bits = 1 << np.arange(len(planes), dtype=np.int64)

    @F.pandas_udf(ty.LongType())
    def signed(batch: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(batch), dtype="Int64")
        known = np.flatnonzero(batch.notna())
        lengths = np.array([len(x) for x in batch.iloc[known]], int)
        for n in np.unique(lengths):
            rows = known[lengths == n]
            x = np.stack([np.asarray(batch.iloc[r], np.float64) for r in rows]) if n else np.zeros((len(rows), 0))
            k = min(int(n), planes.shape[1])
            out.iloc[rows] = ((x[:, :k] @ planes[:, :k].T >= 0) * bits).sum(1)
        return out

    return signed(v)


@F.pandas_udf(ty.BinaryType())
def to_half(v: pd.Series) -> pd.Series:
    """Little-endian float16 of each component."""
    return v.map(lambda x: np.asarray(x, "<f4").astype("<f2").tobytes(), na_action="ignore")


@F.pandas_udf(ty.ArrayType(ty.FloatType()))
def from_half(v: pd.Series) -> pd.Series:
    return v.map(lambda x: np.frombuffer(x, "<f2").astype("<f4").tolist(), na_action="ignore")


def half_savings(dims: Column) -> tuple[Column, Column, Column]:
    """Bytes of 32-bit and 16-bit vectors, and the per cent saved."""
    return dims * 4, dims * 2, F.lit(50.0)
