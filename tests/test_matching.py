import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.functions import stem
from corvane.operators import matching, rerank, retrieval
from corvane.plans import ask
from corvane.plans import queries as P
from test_core import ask_for, corpus, covers


def block_and_batch():
    rng = random.Random(5)
    words = "abcdefgh"
    texts = [" ".join(rng.choice(words[: rng.randint(2, 8)] + "xyz") for _ in range(rng.randint(0, 40))) or None for _ in range(120)]
    rows = [(100 + i, rng.randint(0, 9), tuple(sorted(rng.sample("abcdefgh", rng.randint(1, 4))))) for i in range(40)]
    block = matching.Block(rows)
    block.codes = block.lexemes
    days = [rng.randint(0, 9) for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(days, pa.int64()), pa.array(texts)], ["chunk_id", "day", "text"])
    want = {}
    for qid, day, t in rows:
        for i, text in enumerate(texts):
            hits = [(p + 1, t.index(w)) for p, w in enumerate((text or "").split()) if w in t]
            if days[i] <= day and len({k for _, k in hits}) == len(t):
                want[qid, i] = len(t), len(hits), covers(hits, len(t))
    return block, batch, want


@pytest.mark.parametrize("cells, hits, pairs", [(1 << 22, 1 << 20, 1 << 20), (200, 30, 50)])
def test_kernels_against_all_intervals(monkeypatch, cells, hits, pairs):
    for name, n in (("CELLS", cells), ("HITS", hits), ("PAIRS", pairs)):
        monkeypatch.setattr(matching, name, n)
    block, batch, want = block_and_batch()
    shared, batches = SimpleNamespace(value=block), [batch.slice(0, 50), batch.slice(50, 0), batch.slice(50)]
    got = [r for b in matching.counted(shared)(iter(batches)) for r in b.to_pylist()]
    assert {(r["qid"], r["chunk_id"]): (r["m"], r["n_hits"]) for r in got} == {k: v[:2] for k, v in want.items()} and len(got) == len(want)
    for limit in (1, 3, 200):
        got = {}
        for b in matching.ranked(shared, limit)(iter(batches)):
            for r in b.to_pylist():
                got.setdefault(r["qid"], []).append((r["chunk_id"], r["score"]))
        for qid in block.qid.tolist():
            best = sorted((-round(s, 6), i) for (q, i), (_, _, s) in want.items() if q == qid)[:limit]
            assert [(i, pytest.approx(-s, abs=1.1e-6)) for s, i in best] == got.get(qid, [])
    assert list(matching.ranked(shared, 3)(iter([]))) == []


def test_halves_go_up():
    assert matching.rounded(np.array([0.0015625, 0.1, 0.0000005, 0.30000049])).tolist() == [0.001563, 0.1, 0.000001, 0.3]


def test_tokens_come_in_parts(monkeypatch):
    monkeypatch.setattr(matching, "TOKENS", 2)
    batch = pa.RecordBatch.from_arrays([pa.array(["The a1-b2", None, "", "C d İx"])], ["text"])
    parts = [b.column(0).to_pylist() for b in matching.distinct_tokens(iter([batch]))]
    assert len(parts) == 3 and {t for p in parts for t in p} == {"the", "a1", "b2", "c", "d", "i", "x"}


def test_blocks_of_sets(spark, monkeypatch):
    """Chunks meet queries inside tasks: no row for each token, query and chunk is joined or shuffled."""
    c = corpus(spark, [(1, "2024-01-01", "supply chains of the firm"), (2, "2024-03-01", "supplies; chain chain"), (3, None, "supply chain"), (4, "2024-01-01", None)])
    q = ask_for(spark, ("the supply chain", "2024-06-30"), ("chain supply", "2024-02-01"), ("chain", "2024-06-30"), ("chain", None), ("of the", "2024-06-30"))
    want = {(0, 0): 2, (0, 1): 3, (1, 0): 2, (2, 0): 1, (2, 1): 2}
    for size in (8 << 20, 1):
        monkeypatch.setattr(retrieval, "BLOCK_BYTES", size)
        out = retrieval.matches(c, q)
        assert "Join" not in out._jdf.queryExecution().toString()
        assert {(r.qid, r.chunk_id): r.n_hits for r in out.collect()} == want
        best = retrieval.lexical(c, q, 1)
        assert "Join" not in best._jdf.queryExecution().toString()
        assert {r.qid: r.chunk_id for r in best.collect()} == {0: 0, 1: 0, 2: 1}  # equal scores: the smaller id
    assert retrieval.matches(c, q.where("qid = 4")).count() == 0


def test_search_and_fetching_share_texts(spark, sf):
    """No filter on texts sets the search's join of documents apart from the one that fetches the hits' texts."""
    plan = retrieval.lexical(P.chunks(spark, sf), P.table_asked(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join FullOuter" in plan and "isnotnull(text" not in plan


def test_words_are_stemmed_where_they_are_met(spark, sf):
    """The stemmer inside tasks agrees with the staged SQL, and a search plans without a pass over the chunks' words."""
    ends = ["", "s", "es", "sses", "ies", "ied", "y", "e", "ed", "ing", "ingly", "edly", "eed", "eedly", "ll", "bbing", "ating", "bled", "izing", "bly", "bility", "ogy"]
    ends += [e for e, _, _ in stem.STEP_2 + stem.STEP_3] + list(stem.STEP_4) + [e[:-1] + "y" for e, _, _ in stem.STEP_2 + stem.STEP_3 if e.endswith("i")]
    heads = ["", "b", "y", "a", "at", "hop", "sky", "try", "say", "yell", "gener", "commun", "arsen", "relat", "luxuri", "mult", "xyz", "7b", "sensi", "conflat"]
    words = {h + e + x for h in heads for e in ends for x in ("", "s", "ing", "ed", "ly", "ness", "y")} | set(stem.OWN) | set(stem.KEPT) | {w + "s" for w in stem.KEPT_LATER} | set(stem.KEPT_LATER)
    made = spark.createDataFrame([(w,) for w in words if w], "w string")
    texts = P._t(spark, sf, "documents").select("text").mapInArrow(matching.distinct_tokens, "w string").distinct()
    found = stem.stemmed(made.unionByName(texts)).collect()
    assert len(found) > 8000 and [(r.w, r.lexeme, stem.stem(r.w)) for r in found if r.lexeme != stem.stem(r.w)] == []


    def failing(batches):
        raise ValueError("read a chunk")

    c = corpus(spark, [(1, "2024-01-01", "Supplies supplied the unrelated zebras"), (2, "2024-01-01", "dying suppl")]).mapInArrow(failing, "chunk_id long, filing_date date, text string")
    q = ask_for(spark, ("the supply", "2024-06-30"), ("die", "2024-06-30"))
    out = retrieval.matches(c, q)  # planned without reading a chunk
    with pytest.raises(Exception, match="read a chunk"):
        out.collect()


def test_few_words_are_held(monkeypatch):
    monkeypatch.setattr(matching, "TOKENS", 2)
    block = matching.Block([(1, 5, ("chain", "suppli"))], ("the",))
    assert [block.coded(t) for t in ("The chains, the supply!", "supplied chain", "no chained the", "")] == [[-1, 0, -1, 1], [1, 0], [-1, 0, -1], []]
    assert len(block.met) <= 5


def test_only_words_that_can_fit_are_stemmed(spark, sf, monkeypatch):
    """The sieve of beginnings and endings passes all words of a block's lexemes, and few others are stemmed."""
    ends = ["", "s", "es", "sses", "ies", "y", "e", "ed", "ing", "edly", "eed", "ll", "bbing", "ating", "bled", "bly", "bility"] + [e for e, _, _ in stem.STEP_2 + stem.STEP_3] + list(stem.STEP_4)
    heads = ["", "b", "y", "at", "hop", "sky", "say", "gener", "relat", "7b", "sensi"]
    words = {h + e + x + z for h in heads for e in ends for x in ends for z in ("", "s", "y")} | set(stem.OWN) | set(stem.KEPT) | set(stem.KEPT_LATER)
    for r in P._t(spark, sf, "documents").select("text").collect():
        words |= set(matching.tokens(r.text or ""))
    words = sorted(words - {""})
    lexemes = sorted({stem.stem(w) for w in words})
    for some in (lexemes, lexemes[::40]):
        block = matching.Block([(i, 1, (x,)) for i, x in enumerate(some)], ("the",))
        want = [-1 if w == "the" else block.lexemes.get(stem.stem(w), -1) for w in words]
        asked, plain = [], stem.stem
        with monkeypatch.context() as m:
            m.setattr(stem, "stem", lambda w: asked.append(w) or plain(w))
            code, sizes = block.encoded([" ".join(words), None, "", "THE the"])
        assert code.tolist() == [*want, -1, -1] and sizes.tolist() == [len(words), 0, 0, 2]
    assert len(asked) < len(words) / 4


def test_pairs_below_the_best_are_not_scored(monkeypatch):
    monkeypatch.setattr(matching, "PAIRS", 1)
    block = matching.Block([(7, 5, ("a1", "b1", "c1"))])
    texts = ["a1 b1 c1 " * 9, "a1 b1 c1", "a1 a1 a1 a1 a1 a1 a1 a1 b1 c1", "c1 b1 a1 " * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array([1] * 4, pa.int64()), pa.array(texts)], ["chunk_id", "day", "text"])
    scored, covers_of = [], matching._Table._covers
    monkeypatch.setattr(matching._Table, "_covers", lambda self, rows, m: scored.append(len(rows)) or covers_of(self, rows, m))
    (out,) = matching.ranked(SimpleNamespace(value=block), 1)(iter([batch.slice(i, 1) for i in range(4)]))
    assert out.column("chunk_id").to_pylist() == [3] and sum(scored) == 2


def test_query_words_are_stemmed_on_their_way(spark, monkeypatch):
    """A search plans no SQL stages of the stemmer; rows of one query are one set."""
    c = corpus(spark, [(1, "2024-01-01", "supply chains of the firm"), (2, "2024-03-01", "supplies")])
    q = ask_for(spark, ("the supply", "2024-06-30"), ("of the", "2024-06-30"))
    q = q.unionByName(q.where("qid = 0").selectExpr("qid", "'Chained!' as query", "as_of", *[x for x in q.columns if x not in ("qid", "query", "as_of")]))

    def no_sql(words):
        raise AssertionError("stemmed in SQL")

    monkeypatch.setattr(stem, "stemmed", no_sql)
    assert [(r.qid, r.chunk_id, r.m, r.n_hits) for r in retrieval.matches(c, q).collect()] == [(0, 0, 2, 2)]


def test_reranking_tokenises_a_text_once(spark):
    rows = [("a b b", "B c", 1 / 3), ("a", None, 0.0), ("", "", 0.0), ("x y", "y, x!", 1.0), (None, "a", 0.0), ("a b c", "c d e f", 1 / 6)]
    out = spark.createDataFrame(rows, "a string, b string, want double").select("want", retrieval.jaccard("a", "b").alias("got"))
    assert [r.got for r in out.collect()] == [r[2] for r in rows]
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2


def test_known_words_are_not_sieved_again(monkeypatch):
    """Words are told apart by all their letters, also where they share a slot or their first 16 letters."""
    monkeypatch.setattr(matching, "_BITS", 3)
    words = ["a" * n for n in range(1, 20)] + ["b", "ab", "ba", "abcdefgha", "abcdefghb", "abcdefghijklmnop", "abcdefghijklmnopq", "0", "00"]
    block = matching.Block([(i, 1, (w,)) for i, w in enumerate(sorted({stem.stem(w) for w in words[::2]}))], ("the",))
    want = [block.lexemes.get(stem.stem(w), -1) for w in words]
    for _ in range(3):
        assert block.encoded([" ".join(words), None, words[-1]])[0].tolist() == [*want, want[-1]]
    monkeypatch.setattr(matching, "_BITS", 20)
    block = matching.Block([(1, 5, ("chain", "suppli"))], ("the",))
    sieved, passed = [], block.sieve.passed
    monkeypatch.setattr(block.sieve, "passed", lambda letters, start, size: sieved.append(len(start)) or passed(letters, start, size))
    for _ in range(2):
        assert block.coded("The chains, the supply!") == [-1, 0, -1, 1]
    assert sieved == [3]


@pytest.mark.parametrize("most", [1 << 18, 40])
def test_covers_of_many_lexemes(monkeypatch, most):
    monkeypatch.setattr(matching, "HITS", most)
    rng = random.Random(9)
    sets = [tuple(sorted(rng.sample("abcdef", n))) for n in (1, 2, 2, 3, 3, 4, 5, 6)]
    texts = [" ".join(rng.choice("abcdefxy"[: rng.randint(6, 8)]) for _ in range(rng.randint(6, 60))) for _ in range(60)]
    block = matching.Block([(i, 5, t) for i, t in enumerate(sets)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([1] * 60, pa.int64()), pa.array(texts)], ["chunk_id", "day", "text"])
    got = {(r["qid"], r["chunk_id"]): r["score"] for b in matching.ranked(SimpleNamespace(value=block), 60)(iter([batch])) for r in b.to_pylist()}
    want = {}
    for q, t in enumerate(sets):
        for i, text in enumerate(texts):
            hits = [(p + 1, t.index(w)) for p, w in enumerate(text.split()) if w in t]
            if len({k for _, k in hits}) == len(t):
                want[q, i] = pytest.approx(covers(hits, len(t)), abs=1.1e-6)
    assert got == want


def test_white_space_at_the_end(spark):
    texts = ["", " ", "a", "a \n", " a b\t\n" + " " * 500, "é" * 300 + " \r\n", " " * 400, ("x " * 150), "a" * 199 + " ", "a" + " " * 199, "a" + " " * 200, " \u00a0 "]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(ask._stripped(F.col("t")).alias("got")).collect()
    assert [r.got for r in out] == [t.rstrip(" \t\n\x0b\f\r") for t in texts]


def test_overlap_tokenises_equal_texts_once(spark, monkeypatch):
    """Reranking takes tokens as the search does, with the results of the expressions."""
    rows = [(1, "a b b", "B c"), (2, "a", None), (3, "", ""), (4, "x y", "y, x!"), (5, None, "a"), (6, "a b c", "c d e f"), (7, "İ k", "\u212a i x"), (8, "a", "\t \u00e9"), (9, None, None), (10, "b", "a b"), (11, "a", "a b"), (12, "c", None)]
    df = spark.createDataFrame(rows, "i int, a string, b string").coalesce(1)
    got = df.select(rerank.token_overlap(F.col("a"), F.col("b")).alias("got"), F.round(retrieval.jaccard("a", "b"), 6).alias("want"))
    assert "regexp_extract_all" not in df.select(rerank.token_overlap(F.col("a"), F.col("b")))._jdf.queryExecution().toString()
    assert [r.got for r in got.collect()] == [r.want for r in got.collect()]
    met, plain = [], matching.words
    monkeypatch.setattr(matching, "words", lambda t: met.append(t) or plain(t))
    assert [list(x) for x in rerank._overlap.func(iter([(pd.Series(["a", "b"]), pd.Series(["a b", "a b"])), (pd.Series(["c", None]), pd.Series(["a b", None]))]))] == [[0.5, 0.5], [0.0, 0.0]]
    assert met.count("a b") == 1


def test_counting_leaves_places_unordered(monkeypatch):
    """Matches are counted by tallies alone; tokens are the same with and without letters beyond ASCII."""
    block = matching.Block([(7, 5, ("a1", "b1")), (8, 5, ("a1",))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([1, 1, 1, 1, 6], pa.int64()), pa.array(["A1 x B1 a1", None, "É B1 İa1 A1", "b1", "a1"])], ["chunk_id", "day", "text"])
    asked = []
    monkeypatch.setattr(matching.np, "argsort", lambda *a, **b: asked.append(a))
    made, hits = [], matching._Table.hits
    monkeypatch.setattr(matching._Table, "hits", lambda self: made.append(self) or hits(self))
    (out,) = matching.counted(SimpleNamespace(value=block))(iter([batch]))
    assert sorted(tuple(r.values()) for r in out.to_pylist()) == [(7, 0, 2, 3), (7, 2, 2, 3), (8, 0, 1, 2), (8, 2, 1, 2)]
    (table,) = made
    assert asked == [] and not {"pos", "start"} & set(vars(table))
    assert table.pos[table.start[1 * 5 + 0]] == 3 and table.pos[table.start[0 * 5 + 2]] == 3
