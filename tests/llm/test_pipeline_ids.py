"""Null and repeated ids through every stage, against brute force over rows."""

import re
import zlib
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest
from corvane.llm import language
from corvane.llm import queries as Q
from pyspark.sql import functions as F
from test_minhash import brute as groups


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def counted(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark, sf):
    """Each tenth id is null; each seventh row is there twice more; each ninth comes again under the id before it, and
    each eleventh without an id."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    i = F.col("doc_id")
    return P.Tables(spark, "test").write(
        docs.withColumn("doc_id", F.when(i % 10 != 3, i))
        .unionByName(docs.where(i % 7 == 0))
        .unionByName(docs.where((i % 7 == 0) & (i % 10 != 3)))
        .unionByName(docs.where(i % 9 == 0).withColumn("doc_id", i - 1))
        .unionByName(docs.where(i % 11 == 0).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    )


@pytest.fixture(scope="module")
def stages(spark, sf, odd):
    out = [odd]
    for _, stage in P.STAGES:
        out.append(P.Tables(spark, "test").write(stage(spark, out[-1], sf)))
    return out


def in_order(spark, df):
    """Rows (doc_id, text), by id (null last), then text hash."""
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    return [(r.doc_id, r.text) for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h or 0))]


def test_language(stages):
    found = language.identify(stages[0], language.fit(language.training_rows(stages[0]))).collect()
    want = Counter((r.doc_id, r.text) for r in found if r.lang_pred != "und" and r.score >= 0.5)
    assert counted(stages[1]) == want
    assert sum(n for (d, _), n in want.items() if d is None) > 0 and max(want.values()) > 2


def test_one_row_of_each_group(spark, odd, stages):
    for before, after in ((odd, P.deduplicated(spark, odd, "")), (stages[1], stages[2])):
        rows = in_order(spark, before)
        # numbered by that order, the smallest number of a group is its representative
        want = Counter(rows[i] for i, _, _, kept in groups([(i, t) for i, (_, t) in enumerate(rows)]) if kept)
        assert counted(after) == want


def test_repeats(spark, stages):
    seen, cut = set(), {}
    for d, t in dict.fromkeys(in_order(spark, stages[2])):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        cut[d, t] = bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    want = Counter()
    for (d, t), n in counted(stages[2]).items():
        if cut[d, t]:
            want[d, cut[d, t]] += n
    assert counted(stages[3]) == want


def test_mix(spark, odd, stages):
    for before, after in ((odd, P.mixed(spark, odd, "")), (stages[3], stages[4])):
        had, got = counted(before), counted(after)
        assert not set(got) - set(had) and all(n <= 2 * had[k] for k, n in got.items())
        assert any(d is None for d, _ in got)
        size, taken, most = Counter(), Counter(), Counter()
        for r in before.collect():
            size[r.source] += words(r.text)
            most[r.source] = max(most[r.source], words(r.text))
        for r in after.collect():
            taken[r.source] += words(r.text)
        for source, target in P.mixing.targets(list(size.items()), P.mixing.MixConfig()).items():
            assert abs(taken[source] - target) <= 2 * most[source]


def test_packing(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path())
    want = []
    for r in stages[4].collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        edges = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages[5].collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
