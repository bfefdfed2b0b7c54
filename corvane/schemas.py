"""Declared tables, and the versions that create and drop them under a root folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TIMES = "created_at timestamp not null, updated_at timestamp not null"

#: DDL of each table; ids are made from the keys (see operators.ingest), so that no counter is needed.
TABLES = {
    "companies": f"id long not null, cik string not null, ticker string, name string not null, sic string, sic_description string, exchange string, {_TIMES}",
    "filings": f"id long not null, company_id long not null, accession_number string not null, form string not null, filing_date date not null, report_date date, primary_document string not null, primary_doc_description string, {_TIMES}",
    "filing_documents": f"id long not null, filing_id long not null, storage_uri string not null, content_hash string not null, byte_size long not null, content_type string not null, source_url string not null, fetched_at timestamp not null, {_TIMES}",
    "filing_chunks": f"id long not null, filing_id long not null, filing_date date not null, ordinal int not null, section string, text string not null, token_count int not null, char_start int not null, char_end int not null, embedding array<float>, {_TIMES}",
}

#: The unique key of each table.
KEYS = {"companies": ["cik"], "filings": ["accession_number"], "filing_documents": ["filing_id"], "filing_chunks": ["filing_id", "ordinal"]}

#: Tables in the order in which versions add them; version 1 is empty.
VERSIONS: tuple[tuple[str, ...], ...] = ((), ("companies", "filings"), ("filing_documents",), ("filing_chunks",))


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def _path(spark: SparkSession, root: str, table: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def upgrade(spark: SparkSession, root: str, to: int = len(VERSIONS)) -> list[str]:
    """Creates the tables up to version ``to`` that are not there yet."""
    made = []
    for tables in VERSIONS[:to]:
        for table in tables:
            path, fs = _path(spark, root, table)
            if not fs.exists(path):
                empty(spark, table).write.parquet(f"{root}/{table}")
                made.append(table)
    return made


def downgrade(spark: SparkSession, root: str, to: int = 0) -> list[str]:
    """Drops the tables of the versions after ``to``, the last one first."""
    gone = []
    for tables in reversed(VERSIONS[to:]):
        for table in reversed(tables):
            path, fs = _path(spark, root, table)
            if fs.delete(path, True):
                gone.append(table)
    return gone


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(schema(table)).parquet(f"{root}/{table}")


def replace(df: DataFrame, root: str, table: str) -> None:
    """Writes a table's next state beside it, then swaps the folders: a reader sees the old or the new one."""
    spark = df.sparkSession
    declared = schema(table)
    df.select(*[df[f.name].cast(f.dataType) for f in declared.fields]).write.mode("overwrite").parquet(f"{root}/{table}.next")
    path, fs = _path(spark, root, table)
    old, next_ = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}.{x}") for x in ("old", "next"))
    fs.delete(old, True)
    if fs.exists(path):
        fs.rename(path, old)
    if not fs.rename(next_, path):
        fs.rename(old, path)
        raise OSError(f"{root}/{table} could not be replaced; the old state stands")
    fs.delete(old, True)
