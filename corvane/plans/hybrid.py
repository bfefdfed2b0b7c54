"""Hybrid search: lexical and dense lists, fused, hydrated by id and reranked, for a table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corvane.functions import text as X
from corvane.operators import rerank as R
from corvane.operators import retrieval as O


def hybrid(chunks: DataFrame, queries: DataFrame, candidates: int = 50, pool: int = 25, k: int = 60, top_k: int = 10, stop: tuple[str, ...] = X.STOP, score: R.Scorer = R.token_overlap) -> DataFrame:
    """(qid, rank, chunk_id, filing_id and section if the chunks have them, filing_date, text, score).

    Texts are fetched for the pool only.  A blank query has no hits; a later row than ``as_of`` is none.
    """
    if top_k <= 0 or candidates <= 0 or pool <= 0 or pool > candidates:
        raise ValueError("top_k, candidates and pool must be positive, pool at most candidates")
    queries = O.asked(queries)
    fused = O.fuse([O.lexical(chunks, queries, candidates, stop), O.dense(chunks, queries, candidates)], k, pool)
    asked = queries.select("qid", "query", "as_of")
    shown = [c for c in ("chunk_id", "filing_id", "filing_date", "section", "text") if c in chunks.columns]
    found = chunks.select(*shown).join(fused.drop("score"), "chunk_id").join(asked, "qid").where("filing_date <= as_of")
    return R.rerank(found, top_k, score).select("qid", "rank", *shown, "score")
