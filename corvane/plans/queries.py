"""Queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schemas
from corvane.clients import chat
from corvane.functions import stem
from corvane.functions import text as X
from corvane.functions import vectors as V
from corvane.operators import chunking, embedding, ingest, merge, retrieval
from corvane.plans import ask
from corvane.plans.hybrid import hybrid
from corvane.sources import filings as S
from corvane.streaming import ingest as stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_DATE = "date_add(DATE'2020-01-01', cast({0} % 1461 as int))"
_SECTION = "CASE WHEN chunk_id % 3 <> 0 THEN 'Item 1. Business' END"


def companies(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as companies; one in four has no ticker."""
    c = _t(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"), F.expr("CASE WHEN c_custkey % 4 <> 0 THEN concat('T', c_custkey) END").alias("ticker"), F.col("c_name").alias("name"))


def filings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as filings of the first 150 companies, dated by id."""
    d = _t(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 150).alias("company_id"), F.concat(F.lit("A-"), F.col("doc_id")).alias("accession_number"), F.expr("CASE doc_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END").alias("form"), F.expr(_DATE.format("doc_id")).alias("filing_date"))


def chunks(spark: SparkSession, sf: str, every: int = 1) -> DataFrame:
    """Rows of documents and embeddings with an id divisible by ``every`` as chunks, joined and dated by id; a filing has its chunk's number."""
    docs, vectors = _t(spark, sf, "documents").select("doc_id", "text"), _t(spark, sf, "embeddings").select("vec_id", "embedding")
    if every > 1:  # before the join, which no filter on its result passes
        docs, vectors = docs.where(F.col("doc_id") % every == 0), vectors.where(F.col("vec_id") % every == 0)
    rows = docs.join(vectors, F.col("doc_id") == F.col("vec_id"), "full").withColumn("chunk_id", F.coalesce("doc_id", "vec_id"))
    return rows.select("chunk_id", F.col("chunk_id").alias("filing_id"), F.expr(_DATE.format("chunk_id")).alias("filing_date"), F.expr(_SECTION).alias("section"), "text", "embedding")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """The passages of ``benchmark`` as queries: their first four tokens, a vector of an id divisible by 100, a date by
    number; and two that match nothing, a blank one and one of stop-words."""
    b = _t(spark, sf, "benchmark")
    first = F.array_join(F.slice(X.tokens(F.col("text")), 1, 4), " ")
    rows = b.select(F.col("item_id").alias("qid"), first.alias("query"), F.expr("date_add(DATE'2021-01-01', cast(item_id * 37 % 1096 as int))").alias("as_of"), ((F.col("item_id") % 5) * 100).alias("vec_id"))
    odd = spark.createDataFrame([(-1, "  "), (-2, "the and")], "qid long, query string").select("qid", "query", F.expr("DATE'2023-06-30'").alias("as_of"), F.expr("CASE WHEN qid = -1 THEN 100L END").alias("vec_id"))
    return rows.unionByName(odd).join(_t(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id", "left").drop("vec_id")


def table_asked(spark: SparkSession, sf: str) -> DataFrame:
    """The query set that grows with the tables: every chunk whose id is divisible by 100, by its first three tokens and vector."""
    first = F.array_join(F.slice(X.tokens(F.coalesce("text", F.lit(""))), 1, 3), " ")
    return chunks(spark, sf, 100).select(F.col("chunk_id").alias("qid"), first.alias("query"), F.col("filing_date").alias("as_of"), F.col("embedding").alias("vector"))


_CHUNKS = f"""WITH chunks AS (SELECT *, chunk_id AS filing_id, DATE '2020-01-01' + CAST(chunk_id % 1461 AS INTEGER) AS filing_date, {_SECTION} AS section
  FROM (SELECT coalesce(doc_id, vec_id) AS chunk_id, text, embedding FROM documents FULL JOIN embeddings ON vec_id = doc_id)),
companies AS (SELECT c_custkey AS id, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, CASE WHEN c_custkey % 4 <> 0 THEN 'T' || c_custkey END AS ticker, c_name AS name FROM customer),
filings AS (SELECT doc_id AS id, doc_id % 150 AS company_id, 'A-' || doc_id AS accession_number, CASE doc_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END AS form, DATE '2020-01-01' + CAST(doc_id % 1461 AS INTEGER) AS filing_date FROM documents),
"""

#: The query sets, as in asked() and table_asked().
_ASKED = {
    "": """asked AS (SELECT qid, query, as_of, embedding AS vector FROM (
  SELECT item_id AS qid, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:4], ' ') AS query, DATE '2021-01-01' + CAST(item_id * 37 % 1096 AS INTEGER) AS as_of, item_id % 5 * 100 AS vid FROM benchmark
  UNION ALL VALUES (-1, '  ', DATE '2023-06-30', 100), (-2, 'the and', DATE '2023-06-30', NULL)) LEFT JOIN embeddings ON vec_id = vid),
""",
    "_table": """asked AS (SELECT chunk_id AS qid, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')[1:3], ' ') AS query, filing_date AS as_of, embedding AS vector FROM chunks WHERE chunk_id % 100 = 0),
""",
}

_STOP = ", ".join(f"'{w}'" for w in X.STOP)

#: Full-text form, matches, cover density, cosine, fusion and reranking: what a search engine's text search and the
#: surveyed pipeline define, written over positions.
_SEARCH = f"""live AS (SELECT * FROM asked WHERE length(trim(query)) > 0),
words AS (SELECT chunk_id, filing_date, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM chunks),
tok AS (SELECT chunk_id, filing_date, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM words),
said AS (SELECT qid, as_of, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+'))) AS token FROM live),
dict AS (SELECT DISTINCT token AS w FROM (SELECT token FROM tok UNION ALL SELECT token FROM said) WHERE token NOT IN ({_STOP})),
{stem.ctes("dict", "stems")},
post AS (SELECT chunk_id, filing_date, pos, lexeme FROM tok JOIN stems ON token = w),
terms AS (SELECT *, count(*) OVER (PARTITION BY qid) AS m FROM (SELECT DISTINCT qid, as_of, lexeme FROM said JOIN stems ON token = w)),
hits AS (SELECT qid, chunk_id, m, pos, lexeme FROM post JOIN terms USING (lexeme) WHERE filing_date <= as_of),
hit AS (SELECT h.*, row_number() OVER (PARTITION BY h.qid, h.chunk_id ORDER BY pos) AS i FROM hits h
  JOIN (SELECT qid, chunk_id FROM hits GROUP BY qid, chunk_id, m HAVING count(DISTINCT lexeme) = m) USING (qid, chunk_id)),
seen AS (SELECT h.qid, h.chunk_id, h.m, h.pos, h.i, max(CASE WHEN h.lexeme = t.lexeme THEN h.pos END) OVER (PARTITION BY h.qid, h.chunk_id, t.lexeme ORDER BY h.pos) AS last
  FROM hit h JOIN terms t ON t.qid = h.qid),
ends AS (SELECT qid, chunk_id, pos, i, min(last) AS start FROM seen GROUP BY qid, chunk_id, pos, i, m HAVING count(last) = m),
covers AS (SELECT e.qid, e.chunk_id, e.start, min(e.pos) AS stop, min(e.i) AS j FROM ends e GROUP BY 1, 2, 3),
scored AS (SELECT c.qid, c.chunk_id, round(sum(0.1 / (1 + (stop - start) - (j - h.i))), 6) AS score FROM covers c
  JOIN hit h ON h.qid = c.qid AND h.chunk_id = c.chunk_id AND h.pos = c.start GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 50),
near AS (SELECT qid, chunk_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(vector AS DOUBLE[])) / nullif(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))), 0), 6) AS score
  FROM chunks, live WHERE embedding IS NOT NULL AND vector IS NOT NULL AND filing_date <= as_of),
den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM near WHERE score IS NOT NULL) WHERE rank <= 50),
both_ AS (SELECT qid, chunk_id, 0 AS branch, rank FROM lex UNION ALL SELECT qid, chunk_id, 1, rank FROM den),
fused0 AS (SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(branch * 1000 + rank) AS first FROM both_ GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, chunk_id) AS rank FROM fused0) WHERE rank <= 25),
cand AS (SELECT f.qid, f.chunk_id, f.rank AS old, filing_id, filing_date, section, text, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS b
  FROM fused f JOIN chunks USING (chunk_id) JOIN live USING (qid) WHERE filing_date <= as_of),
rer0 AS (SELECT *, round(len(list_intersect(a, b)) / CAST(greatest(len(list_distinct(list_concat(a, b))), 1) AS DOUBLE), 6) AS score FROM cand),
rer AS (SELECT * FROM (SELECT qid, chunk_id, filing_id, filing_date, section, text, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, old) AS rank FROM rer0) WHERE rank <= 10),
dl AS (SELECT chunk_id, filing_date, len(w) AS dl FROM words), facts AS (SELECT qid, count(*) AS n, avg(dl) AS avgdl FROM live JOIN dl ON filing_date <= as_of GROUP BY 1),
df AS (SELECT qid, lexeme, count(DISTINCT chunk_id) AS df FROM hits GROUP BY 1, 2), tf AS (SELECT qid, chunk_id, lexeme, count(*) AS tf FROM hits GROUP BY 1, 2, 3),
okapi AS (SELECT qid, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (qid, lexeme) JOIN dl USING (chunk_id) JOIN facts USING (qid) GROUP BY 1, 2),
sourced AS (SELECT l.qid, row_number() OVER (PARTITION BY l.qid ORDER BY l.rank) AS i, coalesce(c.ticker, c.cik) AS ticker, f.form, k.filing_date, coalesce(k.section, '—') AS section, k.text
  FROM lex l JOIN chunks k USING (chunk_id) JOIN filings f ON f.id = k.filing_id JOIN companies c ON c.id = f.company_id WHERE l.rank <= 8),
sources AS (SELECT qid, count(*) AS n, regexp_replace(string_agg('[' || i || '] ' || ticker || ' — ' || form || ' — ' || strftime(filing_date, '%Y-%m-%d') || ' — ' || section || chr(10) || text || chr(10), chr(10) ORDER BY i), '\\s+$', '') AS sources FROM sourced GROUP BY 1)
"""


def search(sql: str):
    """Registers a search over the query set of ``benchmark`` and, as ``<name>_table``, over every hundredth chunk."""

    def add(f):
        for kind, queries_ in (("", asked), ("_table", table_asked)):
            QUERIES[f.__name__ + kind] = lambda spark, sf, queries_=queries_: f(spark, sf, chunks(spark, sf), queries_(spark, sf))
            ORACLE_SQL[f.__name__ + kind] = _CHUNKS + _ASKED[kind] + _SEARCH + sql
        return f

    return add


_TEXT = _CHUNKS + _ASKED[""] + _SEARCH


@query(_TEXT + "SELECT chunk_id, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM tok GROUP BY 1")
def tokenize_stats(spark, sf):
    return retrieval.postings(chunks(spark, sf)).groupBy("chunk_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("token").alias("n_distinct"))


@query(_TEXT + "SELECT token, count(DISTINCT chunk_id) AS df, count(*) AS n FROM tok GROUP BY 1")
def postings_df(spark, sf):
    return retrieval.postings(chunks(spark, sf)).groupBy("token").agg(F.countDistinct("chunk_id").alias("df"), F.count("*").alias("n"))


@query(_TEXT + "SELECT lexeme, count(DISTINCT chunk_id) AS df, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM post GROUP BY 1")
def lexeme_df(spark, sf):
    return retrieval.analysed(chunks(spark, sf)).groupBy("lexeme").agg(F.countDistinct("chunk_id").alias("df"), F.count("*").alias("n"), F.sum("pos").alias("places"))


@query(_TEXT + "SELECT w AS token, lexeme FROM stems WHERE w IN (SELECT token FROM tok)")
def word_stems(spark, sf):
    return retrieval.vocabulary(retrieval.postings(chunks(spark, sf)))


@search("SELECT qid, chunk_id, count(*) AS n_hits FROM hit GROUP BY 1, 2")
def lexical_and_match(spark, sf, c, q):
    return retrieval.matches(c, q).select("qid", "chunk_id", "n_hits")


@search("SELECT qid, chunk_id, score, rank FROM lex")
def lexical_cover_density_topk(spark, sf, c, q):
    return retrieval.lexical(c, q).select("qid", "chunk_id", "score", "rank")


@search("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM okapi) WHERE rank <= 50")
def lexical_bm25_topk(spark, sf, c, q):
    return retrieval.bm25(c, q).select("qid", "chunk_id", "score", "rank")


@search("SELECT qid, chunk_id, score, rank FROM den")
def dense_topk(spark, sf, c, q):
    return retrieval.dense(c, q).select("qid", "chunk_id", "score", "rank")


@search("SELECT qid, chunk_id, score, rank FROM fused")
def rrf_fusion(spark, sf, c, q):
    return retrieval.fuse([retrieval.lexical(c, q), retrieval.dense(c, q)], 60, 25).select("qid", "chunk_id", "score", "rank")


@search("SELECT * FROM rer")
def hybrid_search_batch(spark, sf, c, q):
    return hybrid(c, q)


@search("SELECT qid, count(*) AS n, count(*) FILTER (WHERE filing_date > as_of) AS later FROM rer JOIN asked USING (qid) GROUP BY 1")
def asof_leakage_audit(spark, sf, c, q):
    return hybrid(c, q).join(q.select("qid", "as_of"), "qid").groupBy("qid").agg(F.count("*").alias("n"), F.count_if(F.col("filing_date") > F.col("as_of")).alias("later"))


@search("SELECT qid, count(*) AS n, round(coalesce(sum(quality), 0) / count(*), 6) AS precision_at_k FROM rer LEFT JOIN labels ON doc_id = chunk_id GROUP BY 1")
def precision_at_k(spark, sf, c, q):
    found = hybrid(c, q).join(_t(spark, sf, "labels"), F.col("chunk_id") == F.col("doc_id"), "left")
    return found.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("quality"), F.lit(0)) / F.count("*"), 6).alias("precision_at_k"))


@search("SELECT qid, n, 'Question: ' || query || chr(10) || 'As-of date: ' || strftime(as_of, '%Y-%m-%d') || chr(10) || chr(10) || 'Sources:' || chr(10) || chr(10) || sources || chr(10) AS prompt FROM sources JOIN asked USING (qid)")
def ask_prompt(spark, sf, c, q):
    found = ask.headed(ask.search(c, q), c, filings(spark, sf), companies(spark, sf), q)
    return ask.prompts(found, q)


@search("SELECT qid, n, sources FROM sources")
def format_sources(spark, sf, c, q):
    return ask.sources(ask.headed(ask.search(c, q), c, filings(spark, sf), companies(spark, sf), q))


@query(_TEXT + "SELECT rank, chunk_id, filing_id, filing_date, section, text, score FROM rer WHERE qid = 7")
def hybrid_search(spark, sf):
    return hybrid(chunks(spark, sf), asked(spark, sf).where("qid = 7")).drop("qid")


_BLOCKS = "|".join(X.BLOCKS)


def _html_sql() -> str:
    out = "html"
    for tag in ("script", "style", "noscript", "head"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    for a, b in (("(?s)<!--.*?-->", "' '"), (f"(?i)</({_BLOCKS})>|<br\\s*/?>", "chr(10)"), ("(?s)<[^>]*>", "' '"), ("[ \\t]+", "' '"), (" ?\\n[ \\n]*", "chr(10)"), ("^[ \\n]+|[ \\n]+$", "''")):
        out = f"regexp_replace({out}, '{a}', {b}, 'g')"
    return out


@query(f"SELECT page_id, {_html_sql()} AS text FROM pages")
def html_to_text_native(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.html_to_text_native(F.col("html")).alias("text"))


@query()
def html_to_text_udf(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query()
def chunk_pages(spark, sf):
    return chunking.chunk_html(_t(spark, sf, "pages").select("page_id", "html"), chunking.ChunkConfig(64, 0.15, 8))


def _headed(spark, sf):
    """Documents made of the section headings of every third item, with one line of text under each."""
    part = lambda j, name: F.when((F.col("doc_id") + j) % 3 == 0, F.concat(F.lit(f"{name}\nText {j} of "), F.col("doc_id"), F.lit("\n"))).otherwise("")
    front = F.when(F.col("doc_id") % 2 == 0, F.lit("Front matter\n")).otherwise("")
    return _t(spark, sf, "documents").select("doc_id", F.concat(front, *[part(j, name) for j, (_, name) in enumerate(X.SECTIONS)]).alias("text"))


_HEADED = "WITH names(j, name) AS (VALUES " + ", ".join("({}, '{}')".format(j, name.replace("'", "''")) for j, (_, name) in enumerate(X.SECTIONS)) + """),
parts AS (SELECT doc_id, j, name, CASE WHEN doc_id % 2 = 0 THEN 13 ELSE 0 END AS front, name || chr(10) || 'Text ' || j || ' of ' || doc_id || chr(10) AS part FROM documents, names WHERE (doc_id + j) % 3 = 0),
placed AS (SELECT doc_id, j, name, front + sum(length(part)) OVER (PARTITION BY doc_id ORDER BY j) - length(part) AS start, front + sum(length(part)) OVER (PARTITION BY doc_id) AS n FROM parts),
heads AS (SELECT doc_id, name, start, lead(start, 1, n) OVER (PARTITION BY doc_id ORDER BY start) AS stop FROM placed {where})
SELECT doc_id, CAST(NULL AS VARCHAR) AS section, 0 AS start, CAST(min(start) AS INTEGER) AS stop FROM heads GROUP BY doc_id HAVING min(start) > 0
UNION ALL SELECT doc_id, name, CAST(start AS INTEGER), CAST(stop AS INTEGER) FROM heads"""


@query(_HEADED.format(where="WHERE name NOT LIKE 'Item 14%'"))
def section_partition(spark, sf):
    return _headed(spark, sf).select("doc_id", F.inline(X.sections(F.col("text"))))


@query(_HEADED.format(where=""))
def section_partition_fixed(spark, sf):
    return _headed(spark, sf).select("doc_id", F.inline(X.sections(F.col("text"), fixed=True)))


@query("""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '\\s*(?:\\w+|[^\\w\\s])') AS p FROM documents),
i AS (SELECT *, len(p) AS n, unnest(generate_series(0, CAST(greatest(0, ceil((len(p) - 64) / 55.0)) AS BIGINT))) AS i FROM p WHERE len(p) > 0),
c AS (SELECT doc_id, i, text, least(n - i * 55, 64) AS token_count, length(array_to_string(p[1 : i * 55], '')) AS a, CASE WHEN i * 55 + 64 >= n THEN length(text) ELSE length(array_to_string(p[1 : i * 55 + 64], '')) END AS b FROM i)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ordinal, CAST(NULL AS VARCHAR) AS section, substr(text, a + 1, b - a) AS text, CAST(token_count AS INTEGER) AS token_count, CAST(a AS INTEGER) AS char_start, CAST(b AS INTEGER) AS char_end FROM c WHERE token_count >= 8""")
def chunk_documents(spark, sf):
    return chunking.chunk_text(_t(spark, sf, "documents").select("doc_id", "text"), chunking.ChunkConfig(64, 0.15, 8))


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\s*(?:\\w+|[^\\w\\s])')) AS n FROM documents")
def count_tokens(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", chunking.count_tokens(F.col("text")).cast("long").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS cik FROM customer""")
def ticker_lookup(spark, sf):
    c = _t(spark, sf, "customer")
    # entries come twice under one ticker: the first one counts
    entry = F.struct(F.col("c_custkey").cast("string").alias("cik_str"), F.concat(F.lit("tk"), "c_custkey").alias("ticker"), F.col("c_name").alias("title"))
    raw = c.where("c_custkey % 5 < 3").groupBy((F.col("c_custkey") % 7).alias("g")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", entry.alias("e")))).alias("x"))
    twice = F.transform(F.concat("x.e", "x.e"), lambda e, i: F.struct(i.cast("string").alias("key"), F.struct(F.when(i >= F.size("x"), F.concat(F.lit("9"), e["cik_str"])).otherwise(e["cik_str"]).alias("cik_str"), e["ticker"].alias("ticker"), e["title"].alias("title")).alias("value")))
    known = S.tickers(raw.select(F.to_json(F.map_from_entries(twice)).alias("json")))
    return S.lookup(known, c.select("c_custkey", F.concat(F.lit(" TK"), "c_custkey", F.lit(" ")).alias("ticker"))).select("c_custkey", "cik")


def _submissions(spark, sf):
    """Orders as the submissions of their customers, the newest first; every second report date is blank."""
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    row = F.struct(F.datediff(F.lit("2100-01-01"), "o_orderdate").alias("age"), F.col("o_orderkey").alias("k"), day.alias("d"), F.when(F.col("o_orderkey") % 2 == 0, day).otherwise("").alias("r"), F.col("o_orderpriority").alias("f"))
    g = o.groupBy("o_custkey", "c_name", "c_mktsegment").agg(F.sort_array(F.collect_list(row)).alias("x"))
    each = lambda e, name: F.transform("x", e).alias(name)
    recent = F.struct(each(lambda e: e["k"].cast("string"), "accessionNumber"), each(lambda e: e["d"], "filingDate"), each(lambda e: e["r"], "reportDate"), each(lambda e: e["f"], "form"), each(lambda e: F.lit("a.htm"), "primaryDocument"))
    doc = F.struct(F.col("o_custkey").cast("string").alias("cik"), F.col("c_name").alias("name"), F.array(F.concat(F.lit("T"), "o_custkey")).alias("tickers"), F.array(F.col("c_mktsegment")).alias("exchanges"), F.lit("1").alias("sic"), F.lit("d").alias("sicDescription"), F.struct(recent.alias("recent")).alias("filings"), F.lit(1).alias("unknown"))
    return g.select(F.to_json(doc).alias("json"))


_ORDERS = """WITH o AS (SELECT *, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS place FROM orders),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY place) AS n FROM o WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) WHERE n <= 3)
"""


@query(_ORDERS + """SELECT cik, 'T' || o_custkey AS ticker, CAST(o_orderkey AS VARCHAR) AS accession_number, o_orderpriority AS form, CAST(o_orderdate AS DATE) AS filing_date,
CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS report_date, 'a.htm' AS primary_document, CAST(NULL AS VARCHAR) AS primary_doc_description, CAST(place - 1 AS INTEGER) AS pos FROM o""")
def ingest_unzip(spark, sf):
    return S.filings(_submissions(spark, sf))


@query(_ORDERS + "SELECT cik, CAST(o_orderkey AS VARCHAR) AS accession_number, CAST(place - 1 AS INTEGER) AS pos FROM kept")
def filings_form_filter_latest(spark, sf):
    return S.filings(_submissions(spark, sf), ["1-URGENT", "2-HIGH"], 3).select("cik", "accession_number", "pos")


def _ingested(spark, sf):
    """The driver over all submissions, where some companies and filings are there already, under other values."""
    old = ingest.empty_tables(spark)
    raw, now = _submissions(spark, sf), F.expr("TIMESTAMP'2024-01-01 00:00:00'")
    first = ingest.submissions(raw, old["companies"], old["filings"], now=F.expr("TIMESTAMP'2020-01-01 00:00:00'"))
    had = first.tables["companies"].where("cast(cik as long) % 2 = 0").withColumn("name", F.lit("old name"))
    filed = first.tables["filings"].where("cast(accession_number as long) % 3 = 0").withColumns({"form": F.lit("old"), "company_id": F.lit(-1).cast("long")})
    return ingest.submissions(raw, had, filed, ["1-URGENT", "2-HIGH"], 3, now)


@query(_ORDERS + "SELECT cik, 'T' || any_value(o_custkey) AS ticker, any_value(c_name) AS name, count(*) AS filings_seen, (SELECT count(*) FROM kept k WHERE k.cik = o.cik) AS filings_written FROM o JOIN customer ON c_custkey = o_custkey GROUP BY cik")
def ingest_results(spark, sf):
    return _ingested(spark, sf).results


@query(_ORDERS + "SELECT sum(seen) AS filings_seen, sum(written) AS filings_written FROM (SELECT CAST(count(*) AS BIGINT) AS seen, 0 AS written FROM o UNION ALL SELECT 0, count(*) FROM kept)")
def ingest_totals(spark, sf):
    return ingest.totals(_ingested(spark, sf).results)


@query(_ORDERS + """, old AS (SELECT * FROM o WHERE o_orderkey % 3 = 0)
SELECT CAST(o_orderkey AS VARCHAR) AS accession_number, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM kept) THEN o_orderpriority ELSE 'old' END AS form,
o_orderkey % 3 = 0 AS company_kept, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM kept) THEN 2024 ELSE 2020 END AS updated, CASE WHEN o_orderkey % 3 = 0 THEN 2020 ELSE 2024 END AS created
FROM o WHERE o_orderkey % 3 = 0 OR o_orderkey IN (SELECT o_orderkey FROM kept)""")
def ingest_filings(spark, sf):
    f = _ingested(spark, sf).tables["filings"]
    return f.select("accession_number", "form", (F.col("company_id") == -1).alias("company_kept"), F.year("updated_at").alias("updated"), F.year("created_at").alias("created"))


@query("SELECT c_custkey, 'https://a.test/Archives/edgar/data/' || ltrim(CAST(c_custkey AS VARCHAR), '0') || '/' || replace(c_name, '#', '') || '/d.htm' AS url FROM customer WHERE c_custkey > 0")
def archive_url(spark, sf):
    c = _t(spark, sf, "customer").where("c_custkey > 0")
    return c.select("c_custkey", S.archive_url(F.lit("https://a.test"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.replace("c_name", F.lit("#"), F.lit("-")), F.lit("d.htm")).alias("url"))


@query(_CHUNKS + """newest AS (SELECT f.*, cik, row_number() OVER (PARTITION BY company_id ORDER BY filing_date DESC, accession_number) AS n FROM filings f JOIN companies c ON c.id = company_id WHERE form IN ('10-K', '8-K'))
SELECT cik, accession_number, form, filing_date FROM newest WHERE n <= 2""")
def company_filings(spark, sf):
    return ingest.filings_of(companies(spark, sf), filings(spark, sf), forms=["10-K", "8-K"], limit=2).select("cik", "accession_number", "form", "filing_date")


@query("""SELECT c_custkey AS cik, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS name, c_nationkey AS company_id FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def upsert_companies(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("cik"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("company_id"))
    new = c.where("cik % 3 = 0").withColumn("name", F.upper("name"))
    return merge.upsert(c.where("cik % 2 = 0"), new, "cik", ["name"])


def _bodies(spark, sf):
    """Each document fetched again as its filing's body: one in nine fails; the stored ones are of the document before."""
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("filing_id"), F.lpad((F.col("doc_id") % 150).cast("string"), 10, "0").alias("cik"), "text")
    facts = lambda df: df.withColumns({"content_hash": F.sha2("text", 256), "byte_size": F.octet_length("text").cast("long")}).withColumns({"storage_uri": F.concat(F.lit("b#"), "content_hash"), "content_type": F.lit("text/html"), "source_url": F.lit("u")})
    fetched = facts(d).withColumn("error", F.expr("CASE WHEN filing_id % 9 = 0 THEN 'TransportError' END"))
    before = _t(spark, sf, "documents").select((F.col("doc_id") + 1).alias("filing_id"), F.col("text").alias("was"))
    same = d.where("filing_id % 2 = 0").join(before, "filing_id", "left").withColumn("text", F.when(F.col("filing_id") % 4 == 0, F.col("text")).otherwise(F.coalesce("was", F.lit(""))))
    old = facts(same).withColumns({"id": F.col("filing_id"), "fetched_at": F.expr("TIMESTAMP'2020-01-01 00:00:00'"), "created_at": F.expr("TIMESTAMP'2020-01-01 00:00:00'"), "updated_at": F.expr("TIMESTAMP'2020-01-01 00:00:00'")})
    return ingest.documents(fetched, old.select(*schemas.schema("filing_documents").names), F.expr("TIMESTAMP'2024-01-01 00:00:00'"))


_BODIES = """WITH d AS (SELECT n.doc_id, n.text, CASE WHEN n.doc_id % 4 = 0 THEN n.text ELSE coalesce(o.text, '') END AS was FROM documents n LEFT JOIN documents o ON o.doc_id = n.doc_id - 1),
s AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 'failed' WHEN doc_id % 2 = 0 AND sha256(text) = sha256(was) THEN 'unchanged' ELSE 'written' END AS status FROM d)
"""


@query(_BODIES + "SELECT lpad(CAST(doc_id % 150 AS VARCHAR), 10, '0') AS cik, count(*) AS bodies_seen, count(*) FILTER (status = 'written') AS bodies_written, count(*) FILTER (status = 'unchanged') AS bodies_unchanged, count(*) FILTER (status = 'failed') AS bodies_failed FROM s GROUP BY 1")
def body_results(spark, sf):
    return _bodies(spark, sf).results


@query(_BODIES + """SELECT doc_id AS filing_id, CASE WHEN status = 'written' THEN sha256(text) ELSE sha256(was) END AS content_hash, CASE WHEN status = 'written' THEN strlen(text) ELSE strlen(was) END AS byte_size,
CASE WHEN status = 'written' THEN 2024 ELSE 2020 END AS fetched FROM s WHERE doc_id % 2 = 0 OR status = 'written'""")
def body_hash_upsert(spark, sf):
    t = _bodies(spark, sf).tables["filing_documents"]
    return t.select("filing_id", "content_hash", "byte_size", F.year("fetched_at").alias("fetched"))


def _chunked(spark, sf):
    """Filings chunked from bodies of doc_id % 300 words; some have no document, no body, or are not there at all."""
    d = _t(spark, sf, "documents").select("doc_id", F.expr(_DATE.format("doc_id")).alias("filing_date"))
    known = d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("id"), "filing_date")
    stored = d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("filing_id"), F.concat(F.lit("u"), "doc_id").alias("storage_uri"))
    html = F.concat(F.lit("<html><body><p>"), F.expr("repeat('word ', cast(doc_id % 300 as int))"), F.lit("<p>end</body>"))
    bodies = d.select(F.concat(F.lit("u"), "doc_id").alias("storage_uri"), F.when(F.col("doc_id") % 7 != 0, F.encode(html, "UTF-8")).alias("body"))
    old = spark.range(3).crossJoin(d.where("doc_id % 4 = 0")).select(
        (F.col("doc_id") * 3 + F.col("id")).alias("id"), F.col("doc_id").alias("filing_id"), "filing_date", F.col("id").cast("int").alias("ordinal"), F.lit(None).cast("string").alias("section"), F.lit("old").alias("text"),
        *[F.lit(0).alias(c) for c in ("token_count", "char_start", "char_end")], F.array(F.lit(1.0).cast("float")).alias("embedding"), F.expr("TIMESTAMP'2020-01-01 00:00:00'").alias("created_at"), F.expr("TIMESTAMP'2020-01-01 00:00:00'").alias("updated_at"))
    return ingest.chunks(d.select(F.col("doc_id").alias("filing_id")), known, stored, bodies, old, chunking.ChunkConfig(64, 0.15, 8))


_CHUNKED = """WITH d AS (SELECT doc_id, doc_id % 300 + 1 AS n, CASE WHEN doc_id % 11 = 0 THEN 'filing_not_found' WHEN doc_id % 5 = 0 THEN 'no_body_stored' WHEN doc_id % 7 = 0 THEN 'exception' END AS skipped_reason FROM documents),
c AS (SELECT *, CASE WHEN skipped_reason IS NOT NULL OR n < 8 THEN 0 ELSE 1 + CAST(greatest(0, ceil((n - 64) / 55.0)) AS BIGINT) END AS w FROM d)
"""


@query(_CHUNKED + "SELECT doc_id AS filing_id, skipped_reason, w AS chunks_written, CASE WHEN skipped_reason IS NULL AND doc_id % 4 = 0 THEN 3 ELSE 0 END AS chunks_replaced FROM c")
def chunk_results(spark, sf):
    return _chunked(spark, sf).results


@query(_CHUNKED + """SELECT doc_id AS filing_id, CAST(unnest(range(w)) AS INTEGER) AS ordinal, false AS embedded FROM c
UNION ALL SELECT doc_id, CAST(unnest(range(3)) AS INTEGER), true FROM c WHERE skipped_reason IS NOT NULL AND doc_id % 4 = 0""")
def replace_chunks(spark, sf):
    return _chunked(spark, sf).tables["filing_chunks"].select("filing_id", "ordinal", F.col("embedding").isNotNull().alias("embedded"))


@query(_CHUNKS + """g AS (SELECT id FROM companies WHERE id % 10 = 3), f AS (SELECT * FROM filings WHERE company_id NOT IN (SELECT id FROM g))
SELECT 'companies' AS name, count(*) AS n FROM companies WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'filings', count(*) FROM f
UNION ALL SELECT 'filing_documents', count(*) FROM f UNION ALL SELECT 'filing_chunks', count(*) FROM chunks WHERE filing_id NOT IN (SELECT id FROM filings WHERE company_id IN (SELECT id FROM g))""")
def cascade_delete(spark, sf):
    c, f, k = companies(spark, sf), filings(spark, sf), chunks(spark, sf)
    rest = merge.delete(c, f, f.select(F.col("id").alias("filing_id")), k, c.where("id % 10 = 3").select("cik"))
    out = None
    for name, df in zip(schemas.TABLES, rest):
        one = df.groupBy(F.lit(name).alias("name")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(_CHUNKS + "x AS (SELECT chunk_id % 50 AS filing_id, embedding FROM chunks) SELECT filing_id, count(*) AS chunks_seen, count(*) FILTER (embedding IS NULL) AS chunks_embedded, count(*) FILTER (embedding IS NOT NULL) AS chunks_skipped FROM x GROUP BY 1")
def embed_results(spark, sf):
    return embedding.results(chunks(spark, sf).withColumn("filing_id", F.col("chunk_id") % 50))


@query(_CHUNKS + "x AS (SELECT chunk_id, embedding IS NULL AS new FROM chunks) SELECT chunk_id, new, 64 AS dim, 1.0 AS size FROM x")
def embed_writeback(spark, sf):
    c = chunks(spark, sf)
    done = embedding.write_back(c, lambda: embedding.HashEmbedder(64))
    had = c.where("embedding is not null").select("chunk_id", F.col("embedding").alias("had"))
    return done.join(had, "chunk_id", "left").select("chunk_id", (~F.coalesce(F.col("embedding") == F.col("had"), F.lit(False))).alias("new"), F.size("embedding").alias("dim"), F.round(V.norm(F.col("embedding")), 4).alias("size"))


@query("SELECT source, count(*) AS n FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE embedding IS NULL GROUP BY 1")
def embedding_backlog(spark, sf):
    d, e = _t(spark, sf, "documents"), _t(spark, sf, "embeddings")
    return d.join(e.where("embedding is not null"), d.doc_id == e.vec_id, "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS n, round(embedding[1] / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 7) AS y FROM embeddings")
def l2_normalize(spark, sf):
    e = F.col("embedding")
    return _t(spark, sf, "embeddings").select("vec_id", F.round(V.norm(e), 6).alias("n"), F.round(F.get(V.unit(e), F.lit(0)), 6).alias("x"), F.get(V.rounded(e), F.lit(1)).alias("y"))


@query()
def hash_embed(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", V.hash_embed(64)(F.col("text")).alias("embedding"))


@query("""WITH c AS (SELECT conv_id, 'echo: ' || max_by(text, turn) FILTER (WHERE role = 'user') AS answer, CAST(sum(length(text)) // 4 AS BIGINT) AS input_tokens FROM conversations GROUP BY 1)
SELECT *, CAST(length(answer) // 4 AS BIGINT) AS output_tokens FROM c""")
def echo_completion(spark, sf):
    return chat.echo(_t(spark, sf, "conversations"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'system') AS system, count(*) FILTER (WHERE role <> 'system') AS n_rest FROM conversations GROUP BY 1")
def system_lift(spark, sf):
    return chat.lift(_t(spark, sf, "conversations"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_new_rows(spark, sf):
    """All events as a stream of landed files, each key once, appended by micro-batch; then read back."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='corvane-')}"
    folder = f"{root.rstrip('/')}/corvane-stream-{uuid.uuid4().hex}"
    rows = stream.new_rows(spark, sf, _t(spark, sf, "events").schema, "event_id", "ts", pattern="events.parquet")
    stream.append(rows, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
