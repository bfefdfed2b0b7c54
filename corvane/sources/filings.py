"""Landed filing metadata: ticker maps, submissions with parallel arrays, archive addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUBMISSION = (
    "cik string, name string, tickers array<string>, exchanges array<string>, sic string, sicDescription string, "
    "filings struct<recent:struct<accessionNumber:array<string>,filingDate:array<string>,reportDate:array<string>,"
    "form:array<string>,primaryDocument:array<string>,primaryDocDescription:array<string>>>"
)


def padded(cik: Column) -> Column:
    """Ten digits; longer keys stay whole."""
    key = F.trim(cik)
    return F.when(F.length(key) < 10, F.lpad(key, 10, "0")).otherwise(key)


def tickers(raw: DataFrame) -> DataFrame:
    """(pos, cik, ticker, name) of ticker maps (column json), in the map's order."""
    found = F.from_json("json", "map<string, struct<cik_str:string,ticker:string,title:string>>")
    one = raw.select(F.posexplode(F.map_values(found)).alias("pos", "t"))
    return one.select("pos", padded(F.col("t.cik_str")).alias("cik"), F.col("t.ticker").alias("ticker"), F.col("t.title").alias("name"))


def lookup(known: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked.*, cik) by ``ticker``, in any case and without blanks around: the map's first entry; cik is null if none."""
    first = known.groupBy(F.upper("ticker").alias("_t")).agg(F.min_by("cik", "pos").alias("cik"))
    return asked.join(first, F.upper(F.trim(asked["ticker"])) == F.col("_t"), "left").drop("_t")


def resolve(known: DataFrame, ticker: str) -> str:
    """The company number of one ticker; LookupError if the map lacks it."""
    row = known.where(F.upper("ticker") == ticker.strip().upper()).orderBy("pos").select("cik").head(1)
    if not row:
        raise LookupError(f"ticker not found: {ticker!r}")
    return row[0]["cik"]


def companies(raw: DataFrame) -> DataFrame:
    """(cik, ticker, name, sic, sic_description, exchange) of submissions (column json); first ticker and exchange."""
    d = raw.select(F.from_json("json", SUBMISSION).alias("d"))
    first = lambda c: F.get(f"d.{c}", F.lit(0))
    return d.select(padded(F.col("d.cik")).alias("cik"), first("tickers").alias("ticker"), F.col("d.name").alias("name"), F.col("d.sic").alias("sic"), F.col("d.sicDescription").alias("sic_description"), first("exchanges").alias("exchange"))


_NEEDED = ("filingDate", "form", "primaryDocument")
_COLUMNS = ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument", "primaryDocDescription")


def filings(raw: DataFrame, forms: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """One row for each filing of submissions (column json), in the source's order; blank report dates are null.

    The accession numbers say how many there are: a needed array that is shorter is an error, an optional one gives
    nulls.  ``forms`` keeps those forms, unless one of them is ALL; ``limit`` the first so many of each company then.
    """
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    names = ",".join(f"{c}:string" for c in _COLUMNS)
    doc = raw.select(F.from_json("json", SUBMISSION).alias("d"))
    array = lambda c: F.coalesce(F.col(f"d.filings.recent.{c}"), F.array().cast("array<string>"))
    n = F.size(array("accessionNumber"))
    short = F.raise_error(F.concat(F.lit("a needed array is shorter than the accession numbers: company "), F.coalesce("d.cik", F.lit("?")))).cast("array<string>")
    whole = F.greatest(*[n - F.size(array(c)) for c in _NEEDED]) <= 0
    keys = F.when(whole, array("accessionNumber")).otherwise(short).alias("accessionNumber")
    zipped = F.slice(F.arrays_zip(keys, *[array(c).alias(c) for c in _COLUMNS[1:]]).cast(f"array<struct<{names}>>"), F.lit(1), n)
    rows = doc.select(padded(F.col("d.cik")).alias("cik"), F.get("d.tickers", F.lit(0)).alias("ticker"), F.posexplode(zipped).alias("pos", "f"))
    out = rows.select("cik", "ticker", "pos", F.col("f.accessionNumber").alias("accession_number"), F.col("f.form").alias("form"), F.to_date("f.filingDate").alias("filing_date"), F.expr("cast(try_to_timestamp(nullif(f.reportDate, '')) as date)").alias("report_date"), F.col("f.primaryDocument").alias("primary_document"), F.col("f.primaryDocDescription").alias("primary_doc_description"))
    if forms and not any(f.upper() == "ALL" for f in forms):
        out = out.where(F.col("form").isin(forms))
    if limit is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("cik").orderBy("pos"))).where(F.col("_n") <= limit).drop("_n")
    return out


def archive_url(base: Column, cik: Column, accession: Column, document: Column) -> Column:
    """The document's address; an empty part is an error."""
    number = F.regexp_replace(F.trim(cik), "^0+", "")
    url = F.concat(base, F.lit("/Archives/edgar/data/"), number, F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)
    empty = (F.length(number) == 0) | (F.length(F.trim(accession)) == 0) | (F.length(F.trim(document)) == 0)
    return F.when(empty, F.raise_error(F.lit("company number, accession number and document must not be empty")).cast("string")).otherwise(url)
