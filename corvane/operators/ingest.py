"""Batch drivers: submissions to companies and filings, bodies to documents, documents to chunks.

Each gives the tables' next state and a result row for each item, with its counters and why it was skipped; an item that
fails fails alone.  Ids are made from the keys, so that reruns agree and no counter is shared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions import text as X
from corvane.operators import chunking, merge
from corvane.sources import filings as S


@dataclass(frozen=True)
class Outcome:
    #: The tables' next state, by name.
    tables: dict[str, DataFrame]
    results: DataFrame


def key_id(*keys: str) -> Column:
    """A positive id made from the key columns."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 1).alias("id")


def _stamped(df: DataFrame, now: Column) -> DataFrame:
    return df.withColumns({"created_at": now, "updated_at": now})


def submissions(raw: DataFrame, companies: DataFrame, filings: DataFrame, forms: list[str] | None = None, limit: int | None = None, now: Column | None = None) -> Outcome:
    """Ingests submissions (column json).  results: cik, ticker, name, filings_seen, filings_written.

    Of a key that comes twice the last row in hash order counts.  ``filings_seen`` counts before the form filter and
    the limit, ``filings_written`` after; a filing keeps its company, an updated row its created_at.
    """
    now = F.current_timestamp() if now is None else now
    found = S.companies(raw)
    last = lambda df, key: df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*df.columns).desc()))).where("_n = 1").drop("_n")
    one = last(found, "cik")
    new = _stamped(one.withColumn("id", key_id("cik")), now).select(*companies.columns)
    every = last(S.filings(raw).select("cik", "accession_number").distinct(), "accession_number")
    kept = last(S.filings(raw, forms, limit).drop("ticker", "pos"), "accession_number")
    rows = kept.withColumns({"id": key_id("accession_number"), "company_id": key_id("cik")})
    written = _stamped(rows, now).select(*filings.columns)
    tables = {
        "companies": merge.upsert(companies, new, "cik", ["name", "ticker", "sic", "sic_description", "exchange", "updated_at"]),
        "filings": merge.upsert(filings, written, "accession_number", ["form", "filing_date", "report_date", "primary_document", "primary_doc_description", "updated_at"]),
    }
    count = lambda df, name: df.groupBy("cik").agg(F.count("*").alias(name))
    results = one.select("cik", "ticker", "name").join(count(every, "filings_seen"), "cik", "left").join(count(kept, "filings_written"), "cik", "left")
    return Outcome(tables, results.na.fill(0, ["filings_seen", "filings_written"]))


def filings_of(companies: DataFrame, filings: DataFrame, ciks: DataFrame | None = None, forms: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Filings of the companies (all, or those of ``ciks``) with their cik and ticker, the newest ``limit`` of each."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    chosen = companies if ciks is None else companies.join(ciks.select(S.padded(F.col("cik")).alias("cik")).distinct(), "cik", "left_semi")
    out = filings.join(chosen.select(F.col("id").alias("company_id"), "cik", "ticker", F.col("name").alias("company")), "company_id")
    if forms and not any(f.upper() == "ALL" for f in forms):
        out = out.where(F.col("form").isin(forms))
    if limit is not None:
        newest = Window.partitionBy("company_id").orderBy(F.desc("filing_date"), "accession_number")
        out = out.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit).drop("_n")
    return out


def documents(fetched: DataFrame, old: DataFrame, now: Column | None = None) -> Outcome:
    """Merges fetched bodies (filing_id, cik, content_hash, byte_size, storage_uri, content_type, source_url, error).

    A row with an error, or without a hash, fails alone; one whose hash is the stored one writes nothing.  results: cik,
    bodies_seen, bodies_written, bodies_unchanged, bodies_failed.
    """
    now = F.current_timestamp() if now is None else now
    failed = F.col("error").isNotNull() | F.col("content_hash").isNull()
    tested = merge.changed(old, fetched, "filing_id", "content_hash").withColumn("status", F.when(failed, "failed").otherwise(F.col("status")))
    new = _stamped(tested.where("status = 'written'").withColumns({"id": key_id("filing_id"), "fetched_at": now}), now).select(*old.columns)
    table = merge.upsert(old, new, "filing_id", ["storage_uri", "content_hash", "byte_size", "content_type", "source_url", "fetched_at", "updated_at"])
    tally = [F.count_if(F.col("status") == s).alias(f"bodies_{s}") for s in ("written", "unchanged", "failed")]
    return Outcome({"filing_documents": table}, tested.groupBy("cik").agg(F.count("*").alias("bodies_seen"), *tally))


def chunks(asked: DataFrame, filings: DataFrame, documents: DataFrame, bodies: DataFrame, old: DataFrame, config: chunking.ChunkConfig = chunking.ChunkConfig(), tokenizer: chunking.Tokenizer = chunking.words, now: Column | None = None) -> Outcome:
    """Chunks the filings of ``asked`` (filing_id) anew, from ``bodies`` (storage_uri, body) of HTML.

    results: filing_id, chunks_written, chunks_replaced, skipped_reason: filing_not_found, no_body_stored, exception (a
    stored body that can't be read), or null.  A skipped filing keeps its chunks; new chunks have no vector yet.
    """
    now = F.current_timestamp() if now is None else now
    known = filings.select(F.col("id").alias("filing_id"), "filing_date")
    stored = documents.select("filing_id", "storage_uri")
    read = asked.select("filing_id").distinct().join(known, "filing_id", "left").join(stored, "filing_id", "left").join(bodies.select("storage_uri", "body"), "storage_uri", "left")
    reason = F.when(F.col("filing_date").isNull(), "filing_not_found").when(F.col("storage_uri").isNull(), "no_body_stored").when(F.col("body").isNull(), "exception")
    read = read.select("filing_id", "filing_date", "body", reason.alias("skipped_reason"))
    text = X.html_to_text(F.decode("body", "UTF-8"))
    made = chunking.chunk_text(read.where("skipped_reason is null").select("filing_id", text.alias("text")), config, tokenizer, "filing_id").join(known, "filing_id")
    none = F.lit(None).cast("array<float>")
    new = _stamped(made.withColumns({"id": key_id("filing_id", "ordinal"), "embedding": none}), now).select(*old.columns)
    done = read.where("skipped_reason is null").select("filing_id")
    tally = lambda df, name: df.groupBy("filing_id").agg(F.count("*").alias(name))
    results = read.select("filing_id", "skipped_reason").join(tally(new, "chunks_written"), "filing_id", "left")
    results = results.join(tally(old.join(done, "filing_id", "left_semi"), "chunks_replaced"), "filing_id", "left").na.fill(0, ["chunks_written", "chunks_replaced"])
    return Outcome({"filing_chunks": merge.replace(old, new, "filing_id", done)}, results)


def totals(results: DataFrame) -> DataFrame:
    """One row: the sums of all counters of a driver's results."""
    counters = [c for c, kind in results.dtypes if kind in ("bigint", "int")]
    return results.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters if c != "filing_id"])


def empty_tables(spark) -> dict[str, DataFrame]:
    return {name: schemas.empty(spark, name) for name in schemas.TABLES}
