"""Vector functions over arrays, and the deterministic embedder."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(v: Column) -> Column:
    """A zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def rounded(v: Column, digits: int = 7) -> Column:
    """The vector as a search engine takes it over the wire: numbers of ``digits`` decimals."""
    return F.transform(v, lambda x: F.round(x.cast("double"), digits))


def hash_vector(text: str | None, dim: int) -> np.ndarray:
    """A unit vector drawn with the text's SHA-256 as seed: the first 8 bytes, highest first."""
    seed = int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "big")
    v = np.random.default_rng(seed).standard_normal(dim).astype(np.float32)
    return v / np.linalg.norm(v)


def hash_embed(dim: int = 384):
    """Pandas UDF of :func:`hash_vector`."""
    if dim <= 0:
        raise ValueError("dim must be positive")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: hash_vector(t, dim))

    return embed
