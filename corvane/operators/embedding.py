"""Embedders, and their vectors written back to chunks."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.config import Settings
from corvane.functions import vectors as V
from corvane.sources.fetch import FetchError, Response, TokenBucket, retrying


class Embedder(Protocol):
    """Unit vectors of ``dim`` numbers, one for each text, in order."""

    dim: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic vectors drawn with the text's SHA-256 as seed."""

    def __init__(self, dim: int = 384):
        if dim <= 0:
            raise ValueError("dim must be positive")
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [V.hash_vector(t, self.dim).tolist() for t in texts]


class EmbedderError(RuntimeError):
    """An answer that does not hold the vectors asked for."""


class RemoteEmbedder:
    """Vectors of a service, through a transport (url, headers, body) -> Response that the caller gives."""

    def __init__(self, post: Callable[[str, dict[str, str], bytes], Response], url: str, key: str, dim: int, batch: int = 100, rate: float = 20.0, sleep: Callable[[float], None] = time.sleep):
        if dim <= 0 or batch <= 0:
            raise ValueError("dim and batch must be positive")
        self.post, self.url, self.headers, self.dim, self.batch = post, url, {"Content-Type": "application/json", "X-Api-Key": key}, dim, batch
        self.bucket, self.sleep = TokenBucket(rate, sleep=sleep), sleep

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            out += self._some(list(texts[i : i + self.batch]))
        return out

    def _some(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"texts": texts, "dim": self.dim}).encode()

        def once() -> Response:
            self.bucket.take()
            return self.post(self.url, self.headers, body)

        try:
            found = json.loads(retrying(once, sleep=self.sleep).body)
            vectors = [[float(x) for x in e["values"]] for e in found["embeddings"]]
        except (FetchError, ValueError, KeyError, TypeError) as e:
            raise EmbedderError(f"no vectors: {e}") from e
        if len(vectors) != len(texts):
            raise EmbedderError(f"{len(vectors)} vectors for {len(texts)} texts")
        if any(len(v) != self.dim for v in vectors):
            raise EmbedderError(f"a vector has not {self.dim} numbers")
        return [[x / n for x in v] if (n := math.sqrt(sum(x * x for x in v))) else v for v in vectors]


def embedder(settings: Settings, post: Callable | None = None) -> Embedder:
    if settings.embedding_backend == "deterministic":
        return HashEmbedder(settings.embedding_dim)
    if not settings.embedding_key or post is None:
        raise ValueError("the remote embedder needs a key and a transport")
    return RemoteEmbedder(post, settings.embedding_url, settings.embedding_key, settings.embedding_dim)


def embed_with(make: Callable[[], Embedder], batch: int = 32):
    """Pandas UDF text -> vector; ``make`` runs once in each task, texts go in calls of at most ``batch``."""
    if batch <= 0:
        raise ValueError("batch must be positive")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = make()
        for part in parts:
            texts, out = list(part.fillna("")), []
            for i in range(0, len(texts), batch):
                some = texts[i : i + batch]
                found = own.embed(some)
                if len(found) != len(some):
                    raise ValueError(f"embedder gave {len(found)} vectors for {len(some)} texts")
                for v in found:
                    if len(v) != own.dim:
                        raise ValueError(f"a vector has {len(v)} numbers, not {own.dim}")
                out += found
            yield pd.Series(out, index=part.index, dtype=object)

    return vectors


def write_back(chunks: DataFrame, make: Callable[[], Embedder], batch: int = 32, force: bool = False) -> DataFrame:
    """``chunks`` (text, embedding, ..) with a vector for each row that has none, or for all with ``force``."""
    vector = embed_with(make, batch)(F.col("text"))
    if force:
        return chunks.withColumn("embedding", vector)
    # rows that have one never pass through Python
    new = chunks.where("embedding is null").withColumn("embedding", vector)
    return chunks.where("embedding is not null").unionByName(new)


def results(before: DataFrame, force: bool = False) -> DataFrame:
    """(filing_id, chunks_seen, chunks_embedded, chunks_skipped) of a write-back to ``before``."""
    done = F.lit(True) if force else F.col("embedding").isNull()
    out = before.groupBy("filing_id").agg(F.count("*").alias("chunks_seen"), F.count_if(done).alias("chunks_embedded"))
    return out.withColumn("chunks_skipped", F.col("chunks_seen") - F.col("chunks_embedded"))
