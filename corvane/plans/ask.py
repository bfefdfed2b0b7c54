"""Grounded questions: numbered sources from a search, and the prompt made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import retrieval as O
from corvane.plans.hybrid import hybrid


def headed(hits: DataFrame, chunks: DataFrame, filings: DataFrame, companies: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits (qid, rank, chunk_id) with their chunk, filing and company; none is dated after its query."""
    own = chunks.select("chunk_id", "filing_id", "filing_date", "section", "text")
    filing = filings.select(F.col("id").alias("filing_id"), "company_id", "form", "accession_number")
    company = companies.select(F.col("id").alias("company_id"), F.coalesce("ticker", "cik").alias("ticker"))
    found = hits.select("qid", "rank", "chunk_id").join(own, "chunk_id").join(queries.select("qid", "as_of"), "qid").where("filing_date <= as_of")
    return found.join(filing, "filing_id").join(company, "company_id")


def _stripped(text: Column, tail: int = 200) -> Column:
    """Without white space at the end.  The pattern searches the last characters alone, unless these are all blank."""
    last = F.right(text, F.lit(tail))
    short = F.concat(F.substr(text, F.lit(1), F.char_length(text) - tail), F.regexp_replace(last, "\\s+\\z", ""))
    return F.when(F.regexp_like(last, F.lit("\\S")), short).otherwise(F.regexp_replace(text, "\\s+\\z", ""))


def sources(found: DataFrame) -> DataFrame:
    """(qid, n, sources): the sources of each query, numbered by rank, each under a header of its filing."""
    found = found.withColumn("i", F.expr("row_number() over (partition by qid order by rank)"))
    parts = F.concat_ws(" — ", F.concat(F.lit("["), F.col("i"), F.lit("] "), F.col("ticker")), "form", F.date_format("filing_date", "yyyy-MM-dd"), F.coalesce("section", F.lit("—")))
    block = F.concat(parts, F.lit("\n"), "text", F.lit("\n"))
    # as many as the search returns for one query
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", block.alias("block")))), lambda x: x["block"]), "\n")
    return found.groupBy("qid").agg(F.count("*").alias("n"), joined.alias("sources")).withColumn("sources", _stripped(F.col("sources")))


def prompts(found: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, n, prompt) for the queries that have sources."""
    text = F.concat(F.lit("Question: "), "query", F.lit("\nAs-of date: "), F.date_format("as_of", "yyyy-MM-dd"), F.lit("\n\nSources:\n\n"), "sources", F.lit("\n"))
    return sources(found).join(queries.select("qid", "query", "as_of"), "qid").select("qid", "n", text.alias("prompt"))


def search(chunks: DataFrame, queries: DataFrame, top_k: int = 8, mode: str = "lexical", stop: tuple[str, ...] = X.STOP) -> DataFrame:
    """(qid, rank, chunk_id) by "lexical" or "hybrid" search."""
    if mode == "lexical":
        return O.lexical(chunks, queries, top_k, stop).select("qid", "rank", "chunk_id")
    if mode == "hybrid":
        return hybrid(chunks, queries, top_k=top_k, stop=stop).select("qid", "rank", "chunk_id")
    raise ValueError(f"mode must be lexical or hybrid, not {mode!r}")
