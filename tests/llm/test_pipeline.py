import re
import zlib

import corpus_pipeline as P
import numpy as np
import pytest
from corvane.llm import language
from corvane.llm import queries as Q
from test_minhash import brute as groups


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The stages' input and results, as collected rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(P.Tables(spark, "test").write(stage(spark, out[-1], sf)))
    return out


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def test_all_but_the_last_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_language_stage(spark, stages):
    """What goes is what the operator rejects, and clean documents stay."""
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in stages[:2])
    found = language.identify(stages[0], language.fit(language.training_rows(stages[0]))).collect()
    rejected = {r.doc_id for r in found if r.lang_pred == "und" or r.score < 0.5}
    assert set(before) - set(after) == rejected and all(before[d] == t for d, t in after.items())
    assert len(rejected) <= 0.05 * len(before)


def test_dedup_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {d for d, _, _, kept in groups(rows) if kept}
    assert {r.doc_id for r in stages[2].collect()} == want and len(want) < len(rows)


def test_repeat_stage(stages):
    seen, want = set(), {}
    for r in sorted(stages[2].collect(), key=lambda r: r.doc_id):
        raw = (r.text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        if kept:
            want[r.doc_id] = kept.decode("utf-8", "ignore")
    got = stages[3].collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_mix_stage(stages):
    """Each source's words come within its largest document of the target; no document comes more than twice."""
    before = {r.doc_id: r for r in stages[3].collect()}
    copies = {}
    for r in stages[4].collect():
        assert r.text == before[r.doc_id].text and r.source == before[r.doc_id].source
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 2
    size = {}
    for r in before.values():
        size[r.source] = size.get(r.source, 0) + words(r.text)
    goal = P.mixing.targets(list(size.items()), P.mixing.MixConfig())
    for source, target in goal.items():
        mine = [r for r in before.values() if r.source == source]
        taken = sum(words(r.text) * copies.get(r.doc_id, 0) for r in mine)
        assert abs(taken - target) <= 2 * max(words(r.text) for r in mine)


def test_packing_stage_and_run(spark, sf, stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path())
    want = []
    for r in stages[4].collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        edges = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    for out in (stages[5], P.run(spark, sf)):
        rows = out.collect()
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
        places = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for found in places.values():
            end = 0
            for offset, n in sorted(found):
                assert offset == end
                end += n
            assert end <= 1024
