"""Operators on small rows: chunking, search, embedding, ingestion, storage, fetching and the command line."""

import json
import random
import time

import numpy as np
import pytest
from corvane import cli, config, schemas
from corvane.clients import chat
from corvane.functions import stem
from corvane.functions import text as X
from corvane.functions import vectors as V
from corvane.operators import chunking, embedding, ingest, merge, rerank, retrieval
from corvane.plans import ask
from corvane.plans.hybrid import hybrid
from corvane.sources import blobs, fetch
from corvane.sources import filings as S
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>one<p>two</p>", "one\ntwo"),
        ("<div>Head<p>Body</div>x", "Head Body\nx"),
        ("a<b>b</b>", "a b"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\nb c"),
        ("<head><title>t</title><meta x></head><body>q<script>var x='</p>';</script>w<br/>e", "q w\ne"),
        ("<table><tr><td>1<td>2<tr><td>3</table>z", "1 2\n3\nz"),
        ("x</p>y", "x\ny"),
        ("<html><head><style>s</style><body><p>k", "k"),
        ("&nbsp;a &amp; b&#8217;s", "a & b’s"),
        ("<noscript><p>gone</p></noscript>stay<!-- c -->", "stay"),
        (" l1\nl2  \t x\n\n\n", "l1\nl2 x"),
        (b"caf\xc3\xa9 <b>\xff</b>", "café �"),
        ("", ""),
        (None, ""),
    ],
)
def test_plain(html, text):
    assert X.plain(html) == text


def test_html_to_text_in_spark(spark):
    df = spark.createDataFrame([("<p>one<p>two",), (None,)], "html string")
    assert [r.t for r in df.select(X.html_to_text(F.col("html")).alias("t")).collect()] == ["one\ntwo", ""]


def cut(spark, text, fixed=False):
    df = spark.createDataFrame([(text,)], "t string")
    return [tuple(r) for r in df.select(F.inline(X.sections(F.col("t"), fixed))).collect()]


def test_sections(spark):
    text = "😀 front\nItem 1. Business\nwe\nITEM 1A. Risk Factors and more\nx\nItem 7. Management’s Discussion\ny\nitem 1. business again\n"
    got = cut(spark, text)
    assert [s for s, _, _ in got] == [None, "Item 1. Business", "Item 1A. Risk Factors", "Item 7. Management's Discussion and Analysis"]
    assert "".join(text[a:b] for _, a, b in got) == text
    assert cut(spark, "nothing here") == [(None, 0, 12)]
    hidden = "Item 6. [Reserved]\na\nItem 14. Principal Accountant Fees and Services\nb"
    assert [s for s, _, _ in cut(spark, hidden)] == [None] and len(cut(spark, hidden, True)) == 2
    toc = "Item 1. Business\nItem 1A. Risk Factors\nItem 8. Financial Statements\nItem 1. Business\nbody"
    assert [(s, text_) for (s, a, b) in cut(spark, toc) for text_ in [toc[a:b]]][-1][1].endswith("Item 1. Business\nbody")


def test_chunks_are_spans(spark):
    rng = random.Random(1)
    words = ["alpha", "naïve", "😀", "x-y", "12.5", "it's"]
    rows = []
    for i in range(30):
        body = lambda: rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 200)))
        rows.append((i, f"{body()}\nItem 1. Business\n{body()}\nItem 2. Properties\n{body()}  "))
    rows += [(100, None), (101, ""), (102, " \n "), (103, "one two")]
    config_ = chunking.ChunkConfig(32, 0.25, 4)
    out = chunking.chunk_text(spark.createDataFrame(rows, "doc_id long, text string"), config_).collect()
    texts, by = dict(rows), {}
    for r in out:
        assert texts[r.doc_id][r.char_start : r.char_end] == r.text and 4 <= r.token_count <= 32
        by.setdefault(r.doc_id, []).append(r)
    for found in by.values():
        assert [r.ordinal for r in sorted(found, key=lambda r: (r.char_start, r.char_end))] == list(range(len(found)))
        for a, b in zip(found, found[1:]):
            if a.section == b.section:
                assert a.char_start < b.char_start < a.char_end <= b.char_end  # windows overlap
    assert not {100, 101, 102, 103} & set(by)
    assert max(r.char_end for r in by[5]) == len(texts[5])


def test_windows_like_a_loop(spark):
    for n, target, overlap in [(1, 8, 0.25), (8, 8, 0.25), (9, 8, 0.25), (200, 64, 0.25), (50, 32, 0.9), (77, 10, 0.0)]:
        c = chunking.ChunkConfig(target, overlap, 0)
        want, start = [], 0
        while start < n:
            want.append(min(start + target, n) - start)
            if start + target >= n:
                break
            start += c.step
        out = chunking.chunk_text(spark.createDataFrame([(1, "w " * n)], "doc_id long, text string"), c).orderBy("ordinal").collect()
        assert [r.token_count for r in out] == want
    for bad in [(0, 0.1, 0), (8, 1.0, 0), (8, 0.1, 9)]:
        with pytest.raises(ValueError):
            chunking.ChunkConfig(*bad)


def test_tokenizer_from_file(spark):
    import public_tokenizers

    tokenizer = chunking.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    text = "Item 1. Business\nThe naïve 😀 text, " + "goes on and on. " * 40
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = chunking.chunk_text(df, chunking.ChunkConfig(16, 0.25, 2), tokenizer).orderBy("ordinal").collect()
    assert all(text[r.char_start : r.char_end] == r.text and r.token_count <= 16 for r in out) and out[-1].char_end == len(text)
    assert df.select(chunking.count_tokens(F.col("text"), tokenizer)).head()[0] > 40


def test_chunk_html_leaks_no_script(spark):
    html = "<html><head><script>secret()</script></head><body><h1>Item 1. Business</h1><p>" + "fine words " * 60 + "</p></body>"
    out = chunking.chunk_html(spark.createDataFrame([(1, html)], "page_id long, html string"), chunking.ChunkConfig(64, 0.1, 4)).collect()
    assert out and all("secret" not in r.text and r.section == "Item 1. Business" for r in out)


STEMS = "consigned:consign consistency:consist knightly:knight relational:relat hopping:hop hoping:hope happily:happili dying:die operational:oper ties:tie cries:cri gas:gas agreed:agre luxuriated:luxuri revenues:revenu inventories:inventori proceed:proceed skies:sky by:by say:say boyish:boyish hopefulness:hope rate:rate controlling:control falling:fall filing:file troubled:troubl sing:sing knackeries:knackeri rational:ration formative:format writes:write x1:x1 2024:2024 yes:yes"


def test_stems(spark):
    pairs = dict(x.split(":") for x in STEMS.split())
    got = stem.stemmed(spark.createDataFrame([(w,) for w in pairs], "w string")).where("lexeme is not null").collect()
    assert {r.w: r.lexeme for r in got} == pairs


def corpus(spark, rows):
    return spark.createDataFrame([(i, f, d, t) for i, (f, d, t) in enumerate(rows)], "chunk_id long, filing_id long, day string, text string").selectExpr("chunk_id", "filing_id", "to_date(day) AS filing_date", "cast(null AS string) AS section", "text", "cast(null AS array<float>) AS embedding")


def ask_for(spark, *rows):
    return spark.createDataFrame([(i, q, d, v) for i, (q, d, *v) in enumerate(rows) for v in [v[0] if v else None]], "qid long, query string, day string, vector array<double>").selectExpr("qid", "query", "to_date(day) AS as_of", "vector")


def test_search_by_stems_dates_and_stop_words(spark):
    c = corpus(spark, [(1, "2024-06-30", "inventories were written down"), (2, "2024-07-01", "an inventory write-down; the inventory writes"), (3, "2023-01-01", "the and of"), (4, "2023-01-01", "supply chain"), (5, "2023-01-01", "supply chain and supply chain"), (6, "2023-01-01", None)])
    q = ask_for(spark, ("The Inventory", "2024-06-30"), ("inventory", "2024-07-01"), ("the and", "2025-01-01"), (" \t", "2025-01-01"), ("supplies chains", "2025-01-01"), ("missing inventory", "2025-01-01"))
    got = {}
    for r in retrieval.lexical(c, q).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.chunk_id, r.score))
    assert {k: [i for i, _ in v] for k, v in got.items()} == {0: [0], 1: [1, 0], 4: [4, 3]}
    assert got[4][0][1] > got[4][1][1]
    assert {r.qid for r in retrieval.bm25(c, q).collect()} == {0, 1, 4, 5}
    with pytest.raises(ValueError):
        retrieval.lexical(c, q, 0)
    for bad in [{"k1": -1.0}, {"b": 1.5}]:
        with pytest.raises(ValueError):
            retrieval.bm25(c, q, **bad)


def test_later_rows_change_no_score(spark):
    rows = [(1, "2024-01-01", "cloud revenue grew"), (2, "2024-02-01", "cloud cloud")]
    q = ask_for(spark, ("cloud revenue", "2024-06-30"))
    later = [*rows, (3, "2024-07-01", "revenue revenue cloud " * 50)]
    for f in (retrieval.bm25, retrieval.lexical):
        assert f(corpus(spark, rows), q).collect() == f(corpus(spark, later), q).collect()
    assert retrieval.bm25(corpus(spark, rows), ask_for(spark, ("cloud", "2020-01-01"), ("cloud", None))).collect() == []


def covers(places, m):
    """0.1 / (1 + noise) over all minimal intervals that hold each of m lexemes, by trying all intervals."""
    whole = [(a, b) for a in range(len(places)) for b in range(a, len(places)) if len({k for _, k in places[a : b + 1]}) == m]
    least = [(a, b) for a, b in whole if not any(a <= c and d <= b and (a, b) != (c, d) for c, d in whole)]
    return sum(0.1 / (1 + places[b][0] - places[a][0] - (b - a)) for a, b in least)


def test_cover_density_against_all_intervals(spark):
    rng, rows = random.Random(2), []
    for i in range(60):
        m = rng.randint(1, 4)
        at = sorted(rng.sample(range(1, 60), rng.randint(m, 14)))
        rows.append((i, m, [(p, rng.randrange(m)) for p in at]))
    rows = [r for r in rows if len({k for _, k in r[2]}) == r[1]]
    df = spark.createDataFrame(rows, "i int, m int, hits array<struct<pos:int,k:int>>")
    got = {r.i: r.s for r in df.select("i", retrieval.cover_density(F.col("hits"), F.col("m")).alias("s")).collect()}
    assert got == pytest.approx({i: covers(h, m) for i, m, h in rows})


def test_cover_density_is_linear(spark):
    took = []
    for n in (500, 20_000, 40_000):
        c, q = corpus(spark, [(1, "2024-01-01", "alpha beta " * (n // 2))]), ask_for(spark, ("alpha beta", "2024-06-30"))
        begin = time.perf_counter()
        assert retrieval.lexical(c, q).count() == 1
        retrieval.lexical(c, q).collect()
        took.append(time.perf_counter() - begin)
    assert took[2] < 2.5 * took[1]


def test_dense(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((200, 8))
    rows = [(i, "2024-01-01" if i % 2 else "2025-01-01", v[i].tolist()) for i in range(200)] + [(200, "2024-01-01", None), (201, "2024-01-01", [0.0] * 8)]
    c = spark.createDataFrame(rows, "chunk_id long, day string, embedding array<double>").selectExpr("chunk_id", "to_date(day) AS filing_date", "embedding")
    q = ask_for(spark, *[("q", "2024-06-30", v[i].tolist()) for i in range(30)], ("q", "2024-06-30", [0.0] * 8), ("q", "2024-06-30"), (" ", "2024-06-30", v[0].tolist()))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for i in range(30):
        s = sorted(((-round(float(u[i] @ u[j]), 6), j) for j in range(1, 200, 2)))[:5]
        want[i] = [(j, -x) for x, j in s]
    for size in (8 << 20, 200):
        monkeypatch.setattr(retrieval, "BLOCK_BYTES", size)
        out = retrieval.dense(c, q, 5)
        assert "CartesianProduct" not in out._jdf.queryExecution().toString()
        got = {}
        for r in out.orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.chunk_id, round(r.score, 6)))
        assert {k: [i for i, _ in x] for k, x in got.items()} == {k: [i for i, _ in x] for k, x in want.items()}
        assert got[1][0] == (1, 1.0)
    assert retrieval.dense(c, q.where("false")).count() == 0


def test_hybrid(spark):
    c = corpus(spark, [(7, "2024-01-01", "alpha beta"), (8, "2026-01-01", "alpha"), (9, "2024-01-01", "gamma")])
    c = c.withColumn("embedding", F.when(F.col("chunk_id") == 2, F.array(F.lit(1.0), F.lit(0.0))).cast("array<float>"))
    q = ask_for(spark, ("alpha", "2025-01-01", [1.0, 0.0]), ("  ", "2025-01-01", [1.0, 0.0]))
    out = hybrid(c, q).orderBy("rank").collect()
    assert [(r.qid, r.chunk_id, r.filing_id) for r in out] == [(0, 0, 7), (0, 2, 9)] and out[0].score == 0.5
    best = rerank.cross_encoder(lambda: lambda pairs: [len(t) for _, t in pairs], batch=1)
    assert [r.text for r in hybrid(c, q, score=best).orderBy("rank").collect()] == ["alpha beta", "gamma"]
    for bad in [{"pool": 60}, {"top_k": 0}, {"candidates": 0}]:
        with pytest.raises(ValueError):
            hybrid(c, q, **bad)


def test_rerankers(spark):
    c = spark.createDataFrame([(0, "alpha beta", t, i) for i, t in enumerate(["beta", "x", "Alpha", "alpha beta", ""])], "qid long, query string, text string, rank int")
    assert [r.text for r in rerank.rerank(c, 3).orderBy("rank").collect()] == ["alpha beta", "beta", "Alpha"]
    assert rerank.scorer("deterministic") is rerank.token_overlap
    rerank.register("flat", lambda: rerank.cross_encoder(lambda: lambda pairs: [0.0] * len(pairs)))
    assert [r.text for r in rerank.rerank(c, 2, rerank.scorer("flat")).orderBy("rank").collect()] == ["beta", "x"]
    with pytest.raises(ValueError):
        rerank.scorer("none")
    with pytest.raises(Exception, match="1 scores for 5 pairs"):
        rerank.rerank(c.coalesce(1), 2, rerank.cross_encoder(lambda: lambda pairs: [1.0])).collect()


def test_fusion(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "qid long, chunk_id long, rank int")
    b = spark.createDataFrame([(0, 3, 1), (0, 2, 2)], "qid long, chunk_id long, rank int")
    assert [(r.chunk_id, r.rank) for r in retrieval.fuse([a, b]).orderBy("rank").collect()] == [(2, 1), (1, 2), (3, 3)]
    assert retrieval.fuse([a, b], limit=1).count() == 1 and retrieval.fuse([a.where("false")]).count() == 0
    for bad in [{"k": 0}, {"limit": 0}]:
        with pytest.raises(ValueError):
            retrieval.fuse([a], **bad)


def test_hash_vectors(spark):
    import hashlib

    seed = int.from_bytes(hashlib.sha256("text é".encode()).digest()[:8], "big")
    v = np.random.default_rng(seed).standard_normal(16).astype(np.float32)
    want = v / np.linalg.norm(v)
    df = spark.createDataFrame([("text é",)], "text string")
    got = np.array(df.select(V.hash_embed(16)(F.col("text"))).head()[0], np.float32)
    assert (got == want).all() and embedding.HashEmbedder(16).embed(["text é"])[0] == want.tolist()
    with pytest.raises(ValueError):
        embedding.HashEmbedder(0)


def test_write_back(spark):
    c = spark.createDataFrame([(1, 1, "a", None), (2, 1, "b", [1.0, 0.0]), (3, 2, None, None)], "id long, filing_id long, text string, embedding array<float>")
    make = lambda: embedding.HashEmbedder(4)
    assert {tuple(r) for r in embedding.results(c).collect()} == {(1, 2, 1, 1), (2, 1, 1, 0)}
    assert {tuple(r) for r in embedding.results(c, True).collect()} == {(1, 2, 2, 0), (2, 1, 1, 0)}
    once = embedding.write_back(c, make)
    assert {r.id: len(r.embedding) for r in once.collect()} == {1: 4, 2: 2, 3: 4}
    assert embedding.results(once).agg(F.sum("chunks_embedded")).head()[0] == 0
    assert all(len(r.embedding) == 4 for r in embedding.write_back(once, make, force=True).collect())

    class Short(embedding.HashEmbedder):
        def embed(self, texts):
            return super().embed(texts)[1:]

    with pytest.raises(Exception, match="embedder gave 0 vectors for 1 texts"):
        embedding.write_back(c, lambda: Short(4), batch=1).collect()
    with pytest.raises(ValueError):
        embedding.embed_with(make, 0)


def test_remote_embedder():
    seen = []

    def post(url, headers, body):
        texts = json.loads(body)["texts"]
        seen.append(len(texts))
        if len(seen) == 1:
            return fetch.Response(503)
        return fetch.Response(200, json.dumps({"embeddings": [{"values": [3.0, 4.0]} for _ in texts]}).encode())

    pauses = []
    e = embedding.RemoteEmbedder(post, "u", "k", 2, batch=2, sleep=pauses.append)
    assert e.embed(["a", "b", "c"]) == [[0.6, 0.8]] * 3 and seen == [2, 2, 1] and pauses[0] == 1.0
    with pytest.raises(embedding.EmbedderError):
        embedding.RemoteEmbedder(lambda *a: fetch.Response(200, b'{"embeddings": []}'), "u", "k", 2).embed(["a"])
    with pytest.raises(embedding.EmbedderError):
        embedding.RemoteEmbedder(lambda *a: fetch.Response(200, b"{}"), "u", "k", 2).embed(["a"])
    with pytest.raises(ValueError):
        embedding.embedder(config.Settings(embedding_backend="remote"))


def test_limiter_and_retries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = fetch.TokenBucket(5, clock=lambda: now[0], sleep=sleep)
    for _ in range(10):
        bucket.take()
    assert sum(slept) == pytest.approx(1.0) and len(slept) == 5
    answers = [fetch.Response(500), fetch.TransportError("down"), fetch.Response(200, b"x")]

    def get():
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    pauses = []
    assert fetch.retrying(get, sleep=pauses.append).body == b"x" and pauses == [1.0, 2.0]
    for status, calls in ((404, 1), (429, 5)):
        seen = []
        with pytest.raises(fetch.FetchError):
            fetch.retrying(lambda: seen.append(1) or fetch.Response(status), sleep=lambda s: None)
        assert len(seen) == calls


def test_archive(spark):
    def transport(url, headers):
        assert headers["User-Agent"] == "me"
        if url.endswith("bad.htm"):
            return fetch.Response(404)
        return fetch.Response(200, url.encode(), {"Content-Type": "text/html"} if "a.htm" in url else {})

    make = lambda: fetch.Archive(transport, "me", sleep=lambda s: None)
    body, kind, url = make().primary_document("0000320193", "0000320193-24-000123", "a.htm")
    assert url == "https://www.sec.gov/Archives/edgar/data/320193/000032019324000123/a.htm" and kind == "text/html"
    for bad in [("000", "1", "d"), ("1", " ", "d"), ("1", "1", "")]:
        with pytest.raises(ValueError):
            fetch.document_url(*bad)
    with pytest.raises(ValueError):
        fetch.Archive(transport, " ")
    f = spark.createDataFrame([(1, "0000000007", "1-2", "a.htm"), (2, "0000000007", "1-3", "bad.htm"), (3, "", "1", "x")], "id long, cik string, accession_number string, primary_document string")
    got = {r.filing_id: (r.content_type, r.error) for r in fetch.bodies(f, make).collect()}
    assert got[1] == ("text/html", None) and "404" in got[2][1] and got[3][1].startswith("ValueError")


def test_blobs(spark, tmp_path):
    b = blobs.backend("local", tmp_path / "files")
    uri = b.put("abcdef", b"one")
    assert b.put("abcdef", b"one") == uri and b.get(uri) == b"one" and b.exists("abcdef") and not b.exists("ab0")
    b.put("x", b"short")
    assert (tmp_path / "files/ab/abcdef").is_file() and (tmp_path / "files/_/x").is_file()
    for bad in ("", "a/b", "..a"):
        with pytest.raises(ValueError):
            b.put(bad, b"")
    with pytest.raises(FileNotFoundError):
        b.get((tmp_path / "none").as_uri())
    with pytest.raises(ValueError):
        b.get("s3://x")
    assert {r.storage_uri: bytes(r.body) for r in blobs.files(spark, str(tmp_path / "files")).collect()}[uri] == b"one"
    folder = str(tmp_path / "table")
    df = spark.createDataFrame([(1, b"one"), (2, b"two"), (3, b"one"), (4, None)], "filing_id long, body binary")
    out = {r.filing_id: r for r in blobs.store(df, folder).collect()}
    blobs.store(df, folder)
    assert blobs.load(spark, folder).count() == 2 and out[1].content_hash == out[3].content_hash and out[4].content_hash is None


def submission(cik, n, short=None, **more):
    recent = {
        "accessionNumber": [f"{cik}-{i}" for i in range(n)], "filingDate": ["2024-11-01"] * n, "reportDate": ["", *["2024-09-28"] * (n - 1)],
        "form": [["10-K", "10-Q", "8-K", "4"][i % 4] for i in range(n)], "primaryDocument": ["a.htm"] * n, "primaryDocDescription": ["x"],
    }
    if short:
        recent[short] = recent[short][:-1]
    return json.dumps({"cik": cik, "name": f"name {cik}", "tickers": [f"T{cik}"] if cik % 2 else [], "exchanges": ["N"], "filings": {"recent": recent}, "other": 1} | more)


def test_submissions(spark):
    raw = spark.createDataFrame([(submission(7, 6),), (submission(320193, 3),)], "json string")
    rows = S.filings(raw).orderBy("cik", "pos").collect()
    assert len(rows) == 9 and rows[0].cik == "0000000007" and rows[0].report_date is None and str(rows[1].report_date) == "2024-09-28"
    assert rows[0].primary_doc_description == "x" and rows[1].primary_doc_description is None and rows[0].ticker == "T7"
    assert [r.accession_number for r in S.filings(raw, ["10-K"], 1).orderBy("cik").collect()] == ["7-0", "320193-0"]
    assert S.filings(raw, ["all", "x"]).count() == 9
    for column in ("filingDate", "form", "primaryDocument"):
        with pytest.raises(Exception, match="shorter than the accession numbers"):
            S.filings(spark.createDataFrame([(submission(7, 3, column),)], "json string")).collect()
    with pytest.raises(ValueError):
        S.filings(raw, limit=0)
    known = S.tickers(spark.createDataFrame([(json.dumps({"0": {"cik_str": 320193, "ticker": "AAPL", "title": "A"}, "1": {"cik_str": 5, "ticker": "aapl", "title": "B"}}),)], "json string"))
    assert S.resolve(known, " aapl ") == "0000320193"
    with pytest.raises(LookupError):
        S.resolve(known, "none")
    with pytest.raises(Exception, match="must not be empty"):
        spark.range(1).select(S.archive_url(F.lit("b"), F.lit("000"), F.lit("1"), F.lit("d"))).collect()


def test_upsert_wants_an_order(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k long, v string")
    with pytest.raises(Exception, match="comes twice without an order"):
        merge.upsert(old, new, "k", ["v"]).collect()
    assert {tuple(r) for r in merge.upsert(old, new, "k", ["v"], "v").collect()} == {(1, "a"), (2, "c"), (3, "e")}
    assert {tuple(r) for r in merge.upsert(old, new.where("v <> 'd'"), "k", []).collect()} == {(1, "a"), (2, "b"), (3, "e")}


def test_settings(tmp_path):
    (tmp_path / "env").write_text("# c\nWAREHOUSE='/w'\nembedding_dim=8\nunknown=1\n")
    s = config.load({"Embedding_Dim": "16"}, str(tmp_path / "env"))
    assert (s.warehouse, s.embedding_dim, s.chat_backend) == ("/w", 16, "echo")
    for bad in [{"chat_backend": "x"}, {"embedding_dim": "0"}]:
        with pytest.raises(ValueError):
            config.load(bad, "none")


def test_chat():
    messages = [chat.Message("system", "a"), chat.Message("user", "hello"), chat.Message("system", "b"), chat.Message("user", "last one")]
    said = chat.EchoChat().complete(messages)
    assert (said.content, said.input_tokens, said.output_tokens) == ("echo: last one", 3, 3)
    assert chat.lifted(messages)[0] == "a\n\nb" and chat.lifted(messages[1:2])[0] is None
    with pytest.raises(ValueError):
        chat.Message("tool", "x")
    with pytest.raises(chat.ChatError):
        chat.EchoChat().complete(messages[:1])
    sent = []

    def post(url, headers, body):
        sent.append(json.loads(body))
        return fetch.Response(200, json.dumps({"content": [{"type": "text", "text": "x"}, {"type": "other"}, {"type": "text", "text": "y"}], "usage": {"input_tokens": 4, "output_tokens": 2}, "stop_reason": "end"}).encode())

    said = chat.RemoteChat(post, "u", "k", "m").complete(messages, 9)
    assert (said.content, said.model, said.input_tokens, said.stop_reason) == ("xy", "m", 4, "end")
    assert sent[0]["system"] == "a\n\nb" and [m["content"] for m in sent[0]["messages"]] == ["hello", "last one"] and sent[0]["max_tokens"] == 9
    with pytest.raises(chat.ChatError):
        chat.RemoteChat(lambda *a: fetch.Response(400), "u", "k", "m").complete(messages)
    with pytest.raises(ValueError):
        chat.RemoteChat(post, "u", "", "m")
    assert isinstance(chat.chat(config.Settings()), chat.EchoChat)


def test_sources_text(spark):
    found = spark.createDataFrame([(0, 1, "T1", "10-K", "2024-01-02", None, "one"), (0, 3, "0000000002", "8-K", "2023-01-02", "Item 1. Business", "two \n")], "qid long, rank int, ticker string, form string, day string, section string, text string").withColumn("filing_date", F.to_date("day"))
    assert ask.sources(found).head().sources == "[1] T1 — 10-K — 2024-01-02 — —\none\n\n[2] 0000000002 — 8-K — 2023-01-02 — Item 1. Business\ntwo"


def test_command_line(spark, tmp_path, capsys):
    root, landed = str(tmp_path / "w"), tmp_path / "landed"
    (landed / "submissions").mkdir(parents=True)
    (landed / "submissions/CIK0000000007.json").write_text(submission(7, 6))
    (landed / "company_tickers.json").write_text(json.dumps({"0": {"cik_str": 7, "ticker": "SVN", "title": "Seven"}}))
    run = lambda *args, **more: cli.main(["--root", root, *args], spark=spark, **more)
    assert run("health") == 1 and run("upgrade") == 0 and run("health") == 0
    body = b"<html><body><p>" + b"the revenues of cloud services grew " * 40 + b"</p></body></html>"
    make = lambda: fetch.Archive(lambda url, headers: fetch.Response(404) if url.endswith("0000073/a.htm") or "/73/" in url else fetch.Response(200, body), "me", sleep=lambda s: None)
    assert run("ingest", "--ticker", "svn", "--landed", str(landed), "--forms", "10-K", "10-Q", "--limit", "3", "--with-bodies", make=make) == 0
    assert schemas.read(spark, root, "filings").count() == 3 and schemas.read(spark, root, "companies").head().cik == "0000000007"
    out = capsys.readouterr().out
    assert "filings_seen=6  filings_written=3" in out and "bodies_seen=3  bodies_written=3  bodies_unchanged=0  bodies_failed=0" in out
    assert run("ingest", "--cik", "7", "--landed", str(landed), "--forms", "10-K", "10-Q", "--limit", "3", "--with-bodies", make=make) == 0
    assert "bodies_written=0  bodies_unchanged=3" in capsys.readouterr().out
    failing = lambda: fetch.Archive(lambda url, headers: fetch.Response(404), "me", sleep=lambda s: None)
    assert run("ingest", "--cik", "7", "--landed", str(landed), "--forms", "ALL", "--with-bodies", make=failing) == 1
    with pytest.raises(LookupError):
        run("ingest", "--ticker", "none", "--landed", str(landed))
    assert run("chunk", "--cik", "7") == 0 and run("embed") == 0
    chunks = schemas.read(spark, root, "filing_chunks").collect()
    assert len(chunks) == 3 and all(len(r.embedding) == 384 for r in chunks)
    capsys.readouterr()
    assert run("ask", "cloud revenue", "--as-of", "2024-12-31", "--top-k", "2") == 0
    out = capsys.readouterr().out
    assert out.startswith("echo: Question: cloud revenue\nAs-of date: 2024-12-31") and "[2] T7 — 10-" in out and "[3] " not in out and "accession=7-" in out
    assert run("ask", "cloud revenue", "--as-of", "2024-12-31", "--mode", "hybrid") == 0
    assert run("ask", "cloud revenue", "--as-of", "2023-12-31") == 1 and run("ask", "the", "--as-of", "2024-12-31") == 1
    assert run("ask", "cloud", "--as-of", "2024-12-31", client=chat.RemoteChat(lambda *a: fetch.Response(400), "u", "k", "m")) == 2
    with pytest.raises(LookupError):
        run("chunk", "--cik", "8")
    assert run("downgrade", "--to", "1") == 0 and run("health") == 1
    with pytest.raises(SystemExit):
        run("ingest", "--ticker", "a", "--cik", "7", "--landed", "x")


def test_stream(spark, tmp_path):
    from corvane.streaming import ingest as stream

    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 01:00:00"), (1, "2024-01-01 02:00:00")], "k long, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(folder)
    go = lambda: stream.append(stream.new_rows(spark, folder, df.schema, "k", "t"), out, state).awaitTermination()
    go()
    go()
    df.where("k = 2").withColumn("k", F.lit(3).cast("long")).write.mode("append").parquet(folder)
    go()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    seen = []
    stream.each_batch(spark.readStream.schema(df.schema).parquet(folder), f"{state}2", lambda batch, n: seen.append(batch.count())).awaitTermination()
    assert sum(seen) == 4
