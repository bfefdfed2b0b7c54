"""Merges as DataFrames: the table after an upsert, replacement, deletion or conditional write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, update: list[str], order: str | None = None) -> DataFrame:
    """``old`` after ``new``: rows of the same key take the columns in ``update``, other keys are added.

    If a key comes twice, the last row by ``order`` counts; without an order that is an error.
    """
    each = Window.partitionBy(key)
    if order is not None:
        new = new.withColumn("_n", F.row_number().over(each.orderBy(F.desc(order)))).where("_n = 1")
    else:
        twice = F.raise_error(F.concat(F.lit(f"{key} comes twice without an order: "), F.col(key).cast("string")))
        new = new.withColumn("_n", F.count("*").over(each)).where(F.when(F.col("_n") > 1, twice.cast("boolean")).otherwise(True))
    new = new.select(*old.columns).withColumn("_new", F.lit(True))
    pick = lambda c: F.when(F.col("n._new") & (F.lit(c in update) | F.col("o._old").isNull()), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    both = old.withColumn("_old", F.lit(True)).alias("o").join(new.alias("n"), key, "full_outer")
    return both.select(*[F.col(c) if c == key else pick(c).alias(c) for c in old.columns])


def changed(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Rows of ``new`` with status: written (new or other content) or unchanged."""
    had = old.select(key, F.col(content).alias("_had"))
    return new.join(had, key, "left").withColumn("status", F.when(F.col(content).eqNullSafe(F.col("_had")), "unchanged").otherwise("written")).drop("_had")


def replace(old: DataFrame, new: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """All rows of each key in ``new`` (or of each in ``keys``, where some have no new row) in place of the old ones."""
    gone = (new if keys is None else keys).select(key).distinct()
    return old.join(gone, key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete(companies: DataFrame, filings: DataFrame, documents: DataFrame, chunks: DataFrame, ciks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without the companies of ``ciks`` (cik) and all that hangs on them."""
    company = companies.join(ciks.select("cik").distinct(), "cik", "left_semi").select(F.col("id").alias("company_id"))
    filing = filings.join(company, "company_id", "left_semi").select(F.col("id").alias("filing_id"))
    rest = lambda df, gone, on: df.join(gone, on, "left_anti").select(*df.columns)
    return rest(companies, ciks.select("cik"), "cik"), rest(filings, company, "company_id"), rest(documents, filing, "filing_id"), rest(chunks, filing, "filing_id")
