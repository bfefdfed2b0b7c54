"""Command lines: ``python -m corvane.cli ask|ingest|chunk|embed|health|upgrade|downgrade``.

Tables lie under ``--root``.  Answers and counters go to standard output, complaints to standard error.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schemas
from corvane.clients.chat import Chat, ChatError, Message, chat
from corvane.config import Settings, load
from corvane.operators import embedding, ingest
from corvane.plans import ask
from corvane.sources import blobs, fetch
from corvane.sources import filings as S

FORMS = ("10-K", "10-Q", "8-K")
INSTRUCTIONS = "Answer from the numbered sources only, and cite them as [1], [2]. Say so if they do not hold the answer."


def _day(text: str) -> date:
    return datetime.strptime(text, "%Y-%m-%d").date()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corvane")
    top.add_argument("--root", default=None, help="folder of the tables")
    commands = top.add_subparsers(dest="command", required=True)
    a = commands.add_parser("ask", help="answer a question from what was filed up to a day")
    a.add_argument("query")
    a.add_argument("--as-of", type=_day, required=True)
    a.add_argument("--top-k", type=int, default=8)
    a.add_argument("--mode", choices=("lexical", "hybrid"), default="lexical")
    i = commands.add_parser("ingest", help="take in landed submissions, and the bodies of their filings")
    who = i.add_mutually_exclusive_group(required=True)
    who.add_argument("--ticker")
    who.add_argument("--cik")
    i.add_argument("--landed", required=True, help="folder with submissions/*.json and company_tickers.json")
    i.add_argument("--forms", nargs="+", default=list(FORMS))
    i.add_argument("--limit", type=int)
    i.add_argument("--with-bodies", action="store_true")
    for name in ("chunk", "embed"):
        c = commands.add_parser(name)
        c.add_argument("--cik")
        c.add_argument("--limit", type=int)
        c.add_argument("--force", action="store_true")
    commands.add_parser("health", help="run a job and read the tables")
    for name in ("upgrade", "downgrade"):
        commands.add_parser(name).add_argument("--to", type=int, default=len(schemas.VERSIONS) if name == "upgrade" else 0)
    return top


def answer(spark: SparkSession, root: str, query: str, as_of: date, top_k: int, mode: str, settings: Settings, client: Chat) -> int:
    """0 with an answer, 1 without a source, 2 without an answer from the client."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    tables = {name: schemas.read(spark, root, name) for name in ("filing_chunks", "filings", "companies")}
    chunks = tables["filing_chunks"].withColumnRenamed("id", "chunk_id")
    queries = spark.createDataFrame([(0, query, as_of)], "qid long, query string, as_of date")
    if mode == "hybrid":
        queries = queries.withColumn("vector", embedding.embed_with(lambda: embedding.embedder(settings))(F.col("query")))
    found = ask.headed(ask.search(chunks, queries, top_k, mode), chunks, tables["filings"], tables["companies"], queries)
    prompt = ask.prompts(found, queries).head(1)
    if not prompt:
        print(f"No source matches; are filings chunked that are dated up to {as_of}?", file=sys.stderr)
        return 1
    try:
        said = client.complete([Message("system", INSTRUCTIONS), Message("user", prompt[0]["prompt"])], 1024)
    except ChatError as e:
        print(f"The chat client failed: {e}", file=sys.stderr)
        return 2
    print(said.content.rstrip())
    print("\nSources\n-------")
    for n, r in enumerate(found.orderBy("rank").collect(), 1):  # top_k rows
        print(f"[{n}] {r.ticker}  {r.form}  {r.filing_date}  accession={r.accession_number}  section={r.section or '—'!r}")
    print(f"\n[{said.model}  in={said.input_tokens}  out={said.output_tokens}  stop={said.stop_reason}]")
    return 0


def take_in(spark: SparkSession, root: str, landed: str, ticker: str | None, cik: str | None, forms: list[str], limit: int | None, make: Callable[[], fetch.Archive] | None) -> int:
    """0 if all went well, 1 if an item failed.  With ``make``, bodies are fetched and stored too."""
    if cik is None:
        known = S.tickers(spark.read.text(f"{landed}/company_tickers.json", wholetext=True).withColumnRenamed("value", "json"))
        cik = S.resolve(known, ticker or "")
    cik = fetch.padded(cik)
    raw = spark.read.text(f"{landed}/submissions/CIK{cik}.json", wholetext=True).withColumnRenamed("value", "json")
    done = ingest.submissions(raw, schemas.read(spark, root, "companies"), schemas.read(spark, root, "filings"), forms, limit)
    _show(done.results)
    for name in ("companies", "filings"):
        schemas.replace(done.tables[name], root, name)
    if make is None:
        return 0
    one = spark.createDataFrame([(cik,)], "cik string")
    wanted = ingest.filings_of(schemas.read(spark, root, "companies"), schemas.read(spark, root, "filings"), one, forms, limit)
    got = blobs.store(fetch.bodies(wanted, make), f"{root}/blobs")
    bodies = ingest.documents(got, schemas.read(spark, root, "filing_documents"))
    results = bodies.results.collect()  # one row for each company
    schemas.replace(bodies.tables["filing_documents"], root, "filing_documents")
    for r in results:
        print("  ".join(f"{k}={v}" for k, v in r.asDict().items()))
    return int(any(r.bodies_failed for r in results))


def _show(results: DataFrame) -> None:
    for r in results.toLocalIterator():
        print("  ".join(f"{k}={v}" for k, v in r.asDict().items()))


def chunk(spark: SparkSession, root: str, cik: str | None, limit: int | None) -> int:
    companies, filings = schemas.read(spark, root, "companies"), schemas.read(spark, root, "filings")
    one = None if cik is None else spark.createDataFrame([(cik,)], "cik string")
    if one is not None and not companies.where(F.col("cik") == fetch.padded(cik)).head(1):
        raise LookupError(f"company not taken in: {cik!r}")
    asked = ingest.filings_of(companies, filings, one, limit=limit).select(F.col("id").alias("filing_id"))
    stored = blobs.load(spark, f"{root}/blobs").select(F.concat(F.lit(f"{root}/blobs#"), F.col("content_hash")).alias("storage_uri"), "body")
    done = ingest.chunks(asked, filings, schemas.read(spark, root, "filing_documents"), stored, schemas.read(spark, root, "filing_chunks"))
    print("  ".join(f"{k}={v}" for k, v in ingest.totals(done.results).head().asDict().items()))
    failed = done.results.where("skipped_reason = 'exception'").head(1)
    schemas.replace(done.tables["filing_chunks"], root, "filing_chunks")
    return int(bool(failed))


def embed(spark: SparkSession, root: str, force: bool, settings: Settings) -> int:
    chunks = schemas.read(spark, root, "filing_chunks")
    print("  ".join(f"{k}={v}" for k, v in ingest.totals(embedding.results(chunks, force)).head().asDict().items()))
    schemas.replace(embedding.write_back(chunks, lambda: embedding.embedder(settings), force=force), root, "filing_chunks")
    return 0


def health(spark: SparkSession, root: str) -> int:
    """0 if a job runs and all tables can be read, 1 otherwise."""
    bad = 0
    checks = {"spark": lambda: spark.range(1).count()} | {name: lambda name=name: schemas.read(spark, root, name).limit(1).count() for name in schemas.TABLES}
    for name, check in checks.items():
        try:
            check()
            print(f"{name}: ok")
        except Exception as e:
            bad += 1
            print(f"{name}: {type(e).__name__}", file=sys.stderr)
    return int(bad > 0)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, client: Chat | None = None, make: Callable[[], fetch.Archive] | None = None) -> int:
    args, settings = parser().parse_args(argv), load()
    root = args.root or settings.warehouse
    spark = spark or SparkSession.builder.appName("corvane").getOrCreate()
    if args.command == "ask":
        return answer(spark, root, args.query, args.as_of, args.top_k, args.mode, settings, client or chat(settings))
    if args.command == "ingest":
        if args.with_bodies and make is None:
            raise SystemExit("--with-bodies needs a transport: call main(make=...) with one")
        return take_in(spark, root, args.landed, args.ticker, args.cik, args.forms, args.limit, make if args.with_bodies else None)
    if args.command == "chunk":
        return chunk(spark, root, args.cik, args.limit)
    if args.command == "embed":
        return embed(spark, root, args.force, settings)
    if args.command == "health":
        return health(spark, root)
    change = schemas.upgrade if args.command == "upgrade" else schemas.downgrade
    print(" ".join(change(spark, root, args.to)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
