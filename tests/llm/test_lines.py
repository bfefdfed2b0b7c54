import hashlib
import random

import duckdb
import pytest
from corvane.llm import queries as Q
from corvane.llm.lines import LineConfig, remove_lines
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, did string, gone int, removed int"


def brute(rows, hashes, config):
    def units(text):
        if config.unit != "sentence":
            mark = "\n" if config.unit == "line" else "\n\n"
            parts = text.split(mark)
            return [p + mark for p in parts[:-1]] + parts[-1:]
        out, at = [""], 0
        while at < len(text):
            out[-1] += text[at]
            if text[at] in " \t" and out[-1].rstrip(" \t")[-1:] in ("." , "!", "?") and out[-1].rstrip(" \t") and text[at + 1 : at + 2] not in (" ", "\t") or text[at] == "\n":
                out.append("")
            at += 1
        return out

    def words(unit):
        for c in "\t\n\v\f\r":
            unit = unit.replace(c, " ")
        return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in unit.split(" ") if x]

    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0, hashes[x[1]])):
        parts, gone = units(t or ""), set()
        for i, first in enumerate(parts):
            run, k = [], i
            while k < len(parts) and len(run) < config.least_words:
                run += words(parts[k])
                k += 1
            if words(first) and len(run) >= config.least_words:
                if tuple(run) in seen:
                    gone.update(range(i, k))
                seen.add(tuple(run))
        kept = "".join(p for k, p in enumerate(parts) if k not in gone)
        out[d, t] = len(parts), len(gone), sum(len(parts[k]) for k in gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def cases():
    rng = random.Random(8)
    lines = ["Shared line", " shared  LINE ", "", "   ", "é😀 wörter", "ÉTÉ", "été", *(f"line {i}" for i in range(12)), "One. Two three! Four five six?  Seven", "a b c d. e f g h i j k l m n o p q r s t u v w x y z. 1 2 3", "lead a b c d. e f g h i j k l m n o p q r s t u v w x y z. 1 2 3 4"]
    rows = [(4, None), (None, "Shared line\nof no id"), (None, None), (5, ""), (6, "\n\n \n"), (7, "é😀 wörter\n" * 4), (8, "x " * 40000), (9, "same\nsame"), (9, "same\nsame"), (9, "another\nsame"), (3, "trailing\n"), (2, "\t\x0b\r\nTrailing\r")]
    for i in range(150):
        rows.append((20 + i * 7 % 151, rng.choice(["\n", "\n\n"]).join(rng.choice(lines) for _ in range(rng.randint(1, 9)))))
    return rows


@pytest.mark.parametrize("config", [LineConfig(least_words=3), LineConfig(), LineConfig("line", 1, 100), LineConfig("paragraph", 4)])
def test_against_brute_force(spark, config):
    rows = cases()
    docs = spark.createDataFrame([(d, t, "clash", 1, 2) for d, t in rows], SCHEMA)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    want = brute(rows, hashes, config)
    out = remove_lines(docs, config).collect()
    assert len(out) == len(rows) and any(r.n_removed for r in out)
    for r in out:
        assert (r.n_units, r.n_removed, r.chars_removed, r.kept_sha256) == want[r.doc_id, r.text]
        assert sum(s.stop - s.start for s in r.removed) == r.chars_removed and r.did == "clash" and r.gone == 1
        ends = [0, *(x for s in r.removed for x in (s.start, s.stop)), len(r.text or "")]
        assert "".join((r.text or "")[a:b] for a, b in zip(ends[::2], ends[1::2])) == r.kept


def test_a_passage_inside_lines(spark):
    passage = "Of one kind. " + " ".join(f"w{i}" for i in range(18)) + ". And then some more words. "
    rows = [(1, "Begins here " + passage + "ends."), (2, "Short line.\nOther lead " + passage + "with another end."), (3, "Short line.\nNothing else in it.")]
    out = {r.doc_id: r for r in remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].n_removed for i in (1, 2, 3)] == [0, 2, 0]
    assert out[2].kept == "Short line.\nOther lead Of one kind. with another end."


def test_empty_table(spark):
    assert remove_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(Q.ORACLE_SQL["op3_lines"]).df()
    got = Q.op3_lines(spark, sf).toPandas()
    assert got.n_removed.sum() > 0
    a, b = (x[sorted(x.columns)].sort_values("doc_id").astype(str).values.tolist() for x in (got, want))
    assert a == b
