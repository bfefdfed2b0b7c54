"""Rerankers: a scorer is a function of two columns (query, text) that gives a score column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators import matching


class RerankerError(RuntimeError):
    """A model that can't be loaded or gives no usable scores."""


class Scorer(Protocol):
    def __call__(self, query: Column, text: Column) -> Column: ...


@F.pandas_udf(T.DoubleType())
def _overlap(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    last, held = None, frozenset()
    for query, text in parts:
        out = []
        for q, t in zip(query, text):
            if t != last:  # candidates of one text often come one after another
                last, held = t, frozenset(matching.words(t)) if t else frozenset()
            asked = set(matching.words(q)) if q else set()
            both = len(asked & held)
            out.append(both / max(len(asked) + len(held) - both, 1))
        yield pd.Series(out, dtype="float64")


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the two token sets that both have; 0 where both are empty.  The same as ``retrieval.jaccard``, rounded, by
    the tokens of a search: by those expressions reranking took four times as long."""
    return F.round(_overlap(query, text), 6)


def cross_encoder(load: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]], batch: int = 32) -> Scorer:
    """Scores by a model of pairs.  ``load`` runs once in each task and gives the model's predict function."""
    if batch <= 0:
        raise ValueError("batch must be positive")

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = None
        for query, text in parts:
            if predict is None:
                try:
                    predict = load()
                except Exception as e:
                    raise RerankerError(f"the model can't be loaded: {e}") from e
            pairs, out = list(zip(query.fillna(""), text.fillna(""))), []
            for i in range(0, len(pairs), batch):
                some = pairs[i : i + batch]
                found = [float(x) for x in predict(some)]
                if len(found) != len(some):
                    raise RerankerError(f"{len(found)} scores for {len(some)} pairs")
                out += found
            yield pd.Series(out, dtype="float64")

    return lambda query, text: score(query, text)


#: Scorers by name; ``register`` adds others.
SCORERS: dict[str, Callable[[], Scorer]] = {"deterministic": lambda: token_overlap}


def register(name: str, make: Callable[[], Scorer]) -> None:
    SCORERS[name] = make


def scorer(name: str) -> Scorer:
    if name not in SCORERS:
        raise ValueError(f"unknown reranker {name!r}; there are {', '.join(sorted(SCORERS))}")
    return SCORERS[name]()


def rerank(candidates: DataFrame, limit: int, score: Scorer = token_overlap) -> DataFrame:
    """Orders candidates (qid, query, text, rank, ..) by score; ties keep their order."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    scored = candidates.withColumn("score", score(F.col("query"), F.col("text")))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
