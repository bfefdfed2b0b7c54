import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from corvane.llm import contextmix, fingerprints, jpeg, language, media, mixing, packing, repeats, reputation
from corvane.llm import queries as Q
from corvane.llm.runindex import RunLengthIndex
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, kept string"
ODD = [(4, None), (None, "a null id"), (5, ""), (6, " \t\n"), (7, "é😀 wörter"), (8, "x " * 9000), (9, "same same same same same same"), (10, "same same same same same same"), (9, "same same same same same same"), (9, "another text")]


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en" if (d or 0) % 2 else None, None if d == 7 else "s" + str((d or 0) % 3), "clash") for d, t in rows], SCHEMA)


def test_repeats_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ab cdé") for _ in range(n))
    shared = [text(150), text(400), "ab" * 120]
    rows = list(ODD)
    for i in range(60):
        rows.append((100 + i * 7 % 61, text(rng.randint(0, 200)) + rng.choice(shared) + text(rng.randint(0, 90)) + rng.choice([*shared, ""])))
    rows += [(300, "z" * 500), (301, "z" * 99), (302, rows[20][1])]
    out = repeats.remove_repeats(table(spark, rows)).collect()
    assert len(out) == len(rows)
    th = {r.text: r.h for r in table(spark, rows).select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    seen, want = {}, {}
    for d, t in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0, th[x[1]])):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.setdefault(raw[i : i + 100], 1)
        want[d, t] = sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()
    for r in out:
        assert (r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id, r.text]


@pytest.mark.parametrize("group", [1, 2000])
def test_crowded_anchors_have_the_same_result(spark, group):
    rng = random.Random(1)
    rows = [(i, "q" * 40 + "".join(rng.choice("xy") for _ in range(7)) + "m" * 80 + rng.choice("pq") * 30) for i in range(50)]
    a, b = (sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(table(spark, rows), repeats.RepeatConfig(group=g)).collect()) for g in (group, 10**6))
    assert a == b


def test_packing(spark):
    rows = [*ODD, *((50 + i, "word " * (i * 37 % 900)) for i in range(120))]
    config = packing.PackingConfig(Q.tokenizer_path())
    out = packing.pack(table(spark, rows), config).collect()
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        end = 0
        for offset, n in sorted(found):
            assert offset == end
            end += n
        assert end <= 1024
    assert len(out) == len({(r.sequence_id, r.offset) for r in out})
    assert len(places) <= 1.05 * sum(r.length for r in out) / 1024 + 1
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(config.tokenizer)
    ids = [*t.encode(ODD[4][1], add_special_tokens=False).ids, 2]
    assert [(r.start, r.length, r.ids_crc32) for r in out if r.doc_id == 7] == [(0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))]


def test_fast_encoding_equals_the_tokenizer(sf):
    import duckdb

    texts = [r[0] or "" for r in duckdb.sql(f"select text from '{sf}/documents.parquet'").fetchall()]
    texts += ["", "<|endoftext|> a", "naïve café x\x1c y\xa0z", "  lead  \n\n x'll 'tis ''s ²³ 12½ é2 日本語", "\t\t x\r\n  ", "x " * 50000, "don't   we've\n \n  they'd '' 'S", "a" * 20000, " " * 20000, "\n" * 9999, "...!" * 5000, "12345" * 4000, "\u0130\u0149 ŉ ǅ \u00ad\u00aa\u00ba"]
    encode = packing.Encoder(packing.PackingConfig(Q.tokenizer_path()))
    assert encode.fast is not None
    for t in texts:
        assert encode(t).tolist() == encode.whole(t).tolist()


def best_fit(counts, length):
    """Sequences that plain best fit, longest pieces first, needs."""
    gaps, n = {}, 0
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            gap = min((g for g, k in gaps.items() if k and g >= size), default=None)
            if gap is None:
                gap, n = length, n + 1
            else:
                gaps[gap] -= 1
            gaps[gap - size] = gaps.get(gap - size, 0) + 1
    return n


def test_plan_uses_exact_complements():
    assert sum(n for _, n in packing.plan({1000: 3, 24: 3, 500: 2, 300: 1, 224: 1}, 1024)) == 5
    assert sum(n for _, n in packing.plan({600: 1, 200: 1, 150: 1, 74: 1, 424: 1}, 1024)) == 2
    rng = random.Random(2)
    for most in (1024, 1024, 200, 40):
        counts = {n: rng.randint(1, 50) for n in rng.sample(range(1, 1025), most) if rng.random() < 0.8}
        used = {}
        made = packing.plan(counts, 1024)
        for lengths, n in made:
            assert sum(lengths) <= 1024
            for x in lengths:
                used[x] = used.get(x, 0) + n
        assert used == counts
        assert sum(n for _, n in made) <= best_fit(counts, 1024)


def test_no_more_sequences_than_best_fit(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.op2_packing(spark, sf).select("length", "sequence_id").collect()
    counts = {}
    for r in out:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert len({r.sequence_id for r in out}) <= best_fit(counts, 1024)


def test_mixing(spark):
    rows = [*ODD, *((50 + i, "word " * (i * 37 % 400)) for i in range(200))]
    documents, schedule = mixing.mix(table(spark, rows), mixing.MixConfig(block_words=64, bucket_rows=10))
    out = documents.collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, [0, r.target, r.source_size, 0])
        by[r.source][0] += r.taken
        by[r.source][3] += r.size
    for taken, target, size, total in by.values():
        assert abs(taken - target) <= 1 and size == total
    parts = {}
    for r in schedule.collect():
        parts[r.slot] = parts.get(r.slot, 0) + r.last - r.first
    assert max(parts.values()) <= 64 and sum(parts.values()) == sum(b[0] for b in by.values())
    assert max(parts) < 1.1 * len(parts)
    assert mixing.targets([("a", 100), ("b", 100), (None, 1000)], mixing.MixConfig()) == {"a": 200.0, "b": 200.0, None: 1400.0}


def test_mixing_against_brute_force(spark):
    rng = random.Random(6)
    rows = [*ODD, *((50 + i, "word " * (i * 37 % 400)) for i in range(150)), *((1000 + i % 5, "same text") for i in range(12))]
    docs = table(spark, rows).withColumn("source", F.when(F.col("doc_id") % 4 == 0, "a").when(F.col("doc_id") % 4 == 1, "ab").when(F.col("doc_id") % 4 == 2, "é"))
    config = mixing.MixConfig(block_words=rng.choice([32, 64]), bucket_rows=7)
    got = sorted(((r.doc_id, r.size, r.source, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(docs, config)[0].collect()), key=str)
    by = {}
    for r in docs.select("*", F.xxhash64("doc_id", "text", F.lit(config.seed)).alias("h")).collect():
        by.setdefault(r.source, []).append((r.h % (1 << 64) >> 1, r.h, r.doc_id, len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))))
    sizes = {s: sum(x[3] for x in d) for s, d in by.items()}
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    # targets: weights 5, 2, 1, repeating; who would exceed twice its size stops there, the rest is shared anew
    goal, free, left = {}, dict(zip(order, [5, 2, 1] * 9)), 1.5 * sum(sizes.values())
    while free:
        unit = left / sum(free.values())
        over = [s for s in free if unit * free[s] > 2 * sizes[s]]
        for s in over or list(free):
            goal[s] = 2.0 * sizes[s] if over else unit * free[s]
            left -= goal[s]
            free.pop(s)
    want = []
    for s, found in by.items():
        words, at, taken = min(round(goal[s]), 2 * sizes[s]), 0, {}
        for pass_ in range(2):
            for k, (_, _, _, size) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0, x[3]))):
                taken[k] = taken.get(k, 0) + max(0, min(at + size, words) - at)
                at += size
        want += [(d, size, s, sizes[s], round(goal[s], 6), taken[k]) for k, (_, _, d, size) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0, x[3])))]
    assert got == sorted(want, key=str)


def test_media_round_trip(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7):
        payload = rng.integers(0, 256, 192 * n, dtype=np.uint8).tobytes()
        assert media.decode(media.encode(payload)).tobytes() == payload
        # and by the general decoder: each sample is a block of equal pixels
        for k, frame in enumerate(media.frames(media.encode(payload))):
            plane = jpeg.luminance(frame)
            assert plane.shape == (96, 128) and (plane == np.kron(plane[::8, ::8], np.ones((8, 8), np.uint8))).all()
            assert plane[::8, ::8].tobytes() == payload[192 * k : 192 * (k + 1)]
    assert media.decode(media.encode(b"\xff\x00" * 96)).tobytes() == b"\xff\x00" * 96
    quiet, loud = np.zeros((10, 192), np.uint8), np.full((10, 192), 200, np.uint8)
    assert media.shots(np.concatenate([quiet, loud])) == [(0, 10), (10, 20)]


def test_media_against_brute_force(spark):
    rows = [*ODD, (60, "a" * 192 * 12 + "\u00ff" * 96 * 12 + "z" * 500)]
    out = media.clips(media.write_media(table(spark, rows))).collect()
    assert len(out) == len(rows)
    want = {}
    for d, t in rows:
        raw = (t or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        frames = [padded[i : i + 192] for i in range(0, len(padded), 192)]
        cuts, diffs = [], []
        for a, b in zip(frames, frames[1:]):
            one, two = ([sum(x * 16 // 256 == k for x in f) for k in range(16)] for f in (a, b))
            diffs.append(sum(abs(x - y) for x, y in zip(one, two)) / 384)
            past = diffs[-26:-1]
            mean = sum(past) / len(past) if past else 0.0
            deviation = math.sqrt(max(sum(x * x for x in past) / len(past) - mean * mean, 0)) if past else 0.0
            if diffs[-1] > mean + 3 * deviation + 1e-9 and diffs[-1] > 0.25:
                cuts.append(len(diffs))
        histogram = [sum(x >> 4 == k for x in padded) for k in range(16)]
        feature = f"{len(frames)};{'.'.join(map(str, [*cuts, len(frames)]))};{'.'.join(map(str, histogram))}"
        file = media.encode(padded)
        edges = [0, *cuts, len(frames)]
        want[d, len(raw)] = (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature, [(k, a * 40, b * 40) for k, (a, b) in enumerate(zip(edges, edges[1:]))])
    for r in out:
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature, [tuple(c) for c in r.clips]) == want[r.doc_id, r.n_bytes] and r.error is None
    assert max(len(r.clips) for r in out) >= 3


def small_jpeg(planes, quant, sampling, restart=0):
    """A baseline frame of the planes, with AC coefficients and one code of 8 bits for each symbol."""
    import struct

    seg = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    # 255 codes of 8 bits and the rest of 9: symbols 0..254 in order, all that 8-bit samples need
    codes = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))
    high, wide = max(v for _, v in sampling), max(h for h, _ in sampling)
    rows, cols = planes[0].shape
    head = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes(quant[jpeg.ZIGZAG].astype(np.uint8))) + seg(0xC4, bytes([0]) + codes) + seg(0xC4, bytes([0x10]) + codes)
    head += seg(0xC0, struct.pack(">BHHB", 8, rows, cols, len(planes)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    if restart:
        head += seg(0xDD, struct.pack(">H", restart))
    head += seg(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + bytes([0, 63, 0]))
    out, bits, unit, last = b"", "", 0, [0] * len(planes)

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        data = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = ""
        return data

    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    for my in range(-(-rows // (8 * high))):
        for mx in range(-(-cols // (8 * wide))):
            if restart and unit and unit % restart == 0:
                out += flush() + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
                last = [0] * len(planes)
            unit += 1
            for i, (h, v) in enumerate(sampling):
                for b in range(h * v):
                    y, x = (my * v + b // h) * 8, (mx * h + b % h) * 8
                    block = np.zeros((8, 8))
                    part = planes[i][y : y + 8, x : x + 8]
                    block[: part.shape[0], : part.shape[1]] = part - 128.0
                    f = np.rint((jpeg.BASIS @ block @ jpeg.BASIS.T).ravel()[jpeg.ZIGZAG] / quant[jpeg.ZIGZAG]).astype(int)
                    n, extra = number(int(f[0]) - last[i])
                    last[i] = int(f[0])
                    bits += format(n, "08b") + extra
                    run = 0
                    for c in f[1:].tolist():
                        if not c:
                            run += 1
                            continue
                        while run > 15:
                            bits += format(0xF0, "08b")
                            run -= 16
                        n, extra = number(c)
                        bits += format(run << 4 | n, "08b") + extra
                        run = 0
                    if run:
                        bits += "00000000"
    return head + out + flush() + b"\xff\xd9"


def test_foreign_frames(spark):
    rng = np.random.default_rng(2)
    y, x = np.mgrid[0:40, 0:56]
    luma = np.clip(128 + 90 * np.sin(x / 5) * np.cos(y / 7) + rng.normal(0, 5, x.shape), 0, 255)
    chroma = np.full((20, 28), 90.0)
    quant = 2.0 + np.arange(64) % 7
    for planes, sampling, restart in [([luma], [(1, 1)], 0), ([luma, chroma, chroma], [(2, 2), (1, 1), (1, 1)], 0), ([luma, chroma, chroma], [(2, 2), (1, 1), (1, 1)], 3)]:
        got = jpeg.luminance(small_jpeg(planes, quant, sampling, restart))
        assert got.shape == luma.shape and np.abs(got - luma).max() < 16 and np.abs(got - luma).mean() < 3
    frame = small_jpeg([luma], quant, [(1, 1)])
    import struct

    body = b"".join(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) & 1) for f in (frame, b"", frame))
    movi = b"LIST" + struct.pack("<I", 4 + len(body)) + b"movi" + body
    avi = b"RIFF" + struct.pack("<I", 4 + len(movi)) + b"AVI " + movi
    assert media.decode(avi).shape == (3, 40 * 56)  # no index; an empty frame repeats the last
    files = [(1, 1, avi), (2, 1, None), (3, 1, b"nothing"), (4, 1, media.encode(b"x" * 192)[:-400]), (5, 1, avi.replace(b"\xff\xc0", b"\xff\xc2")), (6, 1, b"")]
    out = {r.doc_id: r for r in media.clips(spark.createDataFrame(files, "doc_id long, n_bytes long, media binary")).collect()}
    assert out[1].error is None and out[1].payload_bytes == 3 * 40 * 56 and out[1].feature.startswith("3;3;")
    assert all(out[k].error and out[k].feature is None for k in (2, 3, 5, 6)) and out[2].media_bytes is None and out[3].media_bytes == 7
    assert media.clips(media.write_media(table(spark, []))).count() == 0


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = Q.op5_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    model = language.fit(docs)
    a, b = (docs.where(F.col("lang") == x).orderBy("doc_id").first().text for x in ("en", "de"))
    mixed = {r.lang for r in language.identify(table(spark, [(1, a[:800] + " " + b[:800])]), model).first().langs}
    assert {"en", "de"} <= mixed
    odd = language.identify(table(spark, [*ODD, (99, "123 !?")]), model).collect()
    assert {r.lang_pred for r in odd if r.doc_id in (4, 5, 6, 99)} == {"und"}


def test_scoring(spark):
    rng = random.Random(4)
    rows = [*ODD, *((50 + i, " ".join(rng.choice(["The", "cat", "sat", "on", "mats"]) for _ in range(rng.randint(0, 60)))) for i in range(80))]
    out = contextmix.score(table(spark, rows), F.col("doc_id") % 5 != 0).collect()
    assert len(out) == len(rows)
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
    count = {}
    for d, t in rows:
        if d is not None and d % 5:
            for w in [*words(t), "\n"]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted((d or -1, round(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in [*words(t), "\n"]), 5)) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, round(r.base_score, 5)) for r in out) == want
    assert all(r.score <= 0 for r in out)


def direct_tree(taught, texts):
    """log10 probabilities by context-tree weighting, written from its definition."""
    depth, counts, children = contextmix.DEPTH, {}, {}

    def events(text):
        raw = bytes(depth) + text + b"\xff"
        for at in range(depth, len(raw)):
            node = 1
            for level in range(7, -1, -1):
                bit = raw[at] >> level & 1
                yield raw[at - depth : at][::-1], node, bit  # nearest byte first
                node = node << 1 | bit

    for text in taught:
        for context, node, bit in events(text):
            for d in range(depth + 1):
                counts.setdefault((context[:d], node), [0, 0])[bit] += 1
                if d < depth:
                    children.setdefault((context[:d], node), set()).add(context[: d + 1])

    def estimate(key):
        a, b = counts[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted = {}

    def weight(key):
        if key not in weighted:
            own = estimate(key)
            if len(key[0]) < depth:
                below = sum(weight((c, key[1])) for c in children[key])
                own = np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)
            weighted[key] = own
        return weighted[key]

    def one(context, node, d):
        key = context[:d], node
        if key not in counts:
            return 0.5
        a, b = counts[key]
        kt = (b + 0.5) / (a + b + 1)
        if d == depth:
            return kt
        share = math.exp(math.log(0.5) + estimate(key) - weight(key))
        return share * kt + (1 - share) * one(context, node, d + 1)

    return [sum(math.log10(p if bit else 1 - p) for context, node, bit in events(t) for p in [one(context, node, 0)]) for t in texts]


def test_score_against_the_direct_tree(spark):
    rng = random.Random(4)
    rows = [*ODD[:5], *((50 + i, " ".join(rng.choice(["The", "cat", "sät", "on", "mats"]) for _ in range(rng.randint(0, 12)))) for i in range(25))]
    raw = [(t or "").translate({c: c + 32 for c in range(65, 91)}).encode() for _, t in rows]
    want = direct_tree([r for r, (d, _) in zip(raw, rows) if d is not None and d % 5], raw)
    for config in (contextmix.ScoreConfig(), contextmix.ScoreConfig(bucket_bytes=100, partition_grams=50)):
        out = contextmix.score(table(spark, rows), F.col("doc_id") % 5 != 0, config).collect()
        assert sorted(round(r.score, 3) for r in out) == pytest.approx(sorted(want), abs=2e-3)
    assert all(r.n_known <= r.n_tokens for r in out)


def test_context_tree_is_a_distribution():
    text = np.frombuffer(b"abracadabra " * 20, np.uint8)
    grams, counts = np.unique(contextmix._grams(text, np.array([0, len(text)]))[0], return_counts=True)
    levels, rest = contextmix.climb(grams, counts.astype(float))
    levels |= contextmix.top_levels(*rest)
    for context in (0, int(grams[3] >> 8), 0x7A7A7A7A7A):
        p = np.exp(contextmix.log_probability((context << 8) | np.arange(256), levels))
        assert abs(p.sum() - 1) < 1e-9


def test_lookup():
    keys = np.unique(np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 5000))
    keys[7], values = 0, np.arange(5000, dtype=np.float32)
    keys, values = keys[np.argsort(keys)], values
    asked = np.random.default_rng(4).integers(0, len(keys), 20000)
    assert (contextmix.Lookup(keys, values)(keys[asked]) == values[asked]).all()


def test_reputation(spark):
    urls = ["http://A.example.org/es/1", "https://example.org/en/12?x", "http://b.com/fr/1", "http://b.com/de/1", "http://c.net/x#y", None, "nothing", "ftp://h?q", "http://h"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, None, None) for i in range(3)], "doc_id long, quality int, toxic int")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in reputation.judge(pages, labels).collect()}
    assert out[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert out[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert out[2][2:] == ("com/fr/", "allow") and out[3][2:] == ("com/de/", "block")
    assert out[5][:2] == ("", "") and out[6][:2] == ("", "") and out[7][:2] == ("h", "") and len(out) == len(urls)
    bad = spark.createDataFrame([(i, f"http://bad{i % 3}.net/") for i in range(60)] + [(60 + i, "http://good.net/") for i in range(60)], "page_id long, url string")
    marks = spark.createDataFrame([(i, int(i >= 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    got = {(r.host, r.verdict) for r in reputation.judge(bad, marks).collect()}
    assert ("bad0.net", "block") in got and ("good.net", "allow") in got


def shrunk(labelled):
    """Posterior bounds by level from (host, good) pairs, by the formulas of the operator's description."""
    tail = lambda h: (re.search(r"[^.]*\.[^.]*$", h) or re.search(".*", h)).group()
    levels = [{}, {}, {}]
    for host, good in labelled:
        for level, key in zip(levels, (host.split(".")[-1], tail(host), host)):
            n, k = level.get(key, (0, 0))
            level[key] = n + 1, k + good
    n, k = len(labelled), sum(g for _, g in labelled)
    prior, out = {None: (k + 1) / (n + 2)}, []
    for i, level in enumerate(levels):
        p, total = k / n, sum(x for x, _ in level.values())
        within, spread = p * (1 - p), sum(b * b / a for a, b in level.values()) - total * p * p
        room = total - sum(a * a for a, _ in level.values()) / total - (len(level) - 1)
        rho = (spread - within * (len(level) - 1)) / (within * room) if within > 0 and room > 0 else 0.5
        rho = round(min(max(rho, 0.01), 0.99), 9)
        m, mine = (1 - rho) / rho, {}
        for key, (a, b) in level.items():
            up = prior[None if i == 0 else key.split(".")[-1] if i == 1 else tail(key)]
            mean = (b + m * up) / (a + m)
            mine[key] = mean, min(1.0, mean + math.sqrt(mean * (1 - mean) / (a + m + 1)))
        prior = {key: mean for key, (mean, _) in mine.items()}
        out.append({key: bound for key, (_, bound) in mine.items()})
    return out


def test_reputation_against_brute_force(spark):
    rng = random.Random(9)
    hosts = [f"{a}{i % 3}.{b}.{c}" if i % 4 else f"{b}.{c}" for i, (a, b, c) in enumerate((a, b, c) for a in "wx" for b in ("one", "two", "six") for c in ("net", "info", "io"))] + ["alone"]
    share = {h: rng.random() for h in hosts}
    pages = [(i, f"http://{rng.choice(hosts)}/p{i}?q") for i in range(400)] + [(400, "http://new.one.net/"), (401, "http://x.new.io"), (402, "http://a.unseen/"), (403, None), (404, "http:///x")]
    host = lambda u: re.match(r"[^/?#]*", (u or "").partition("://")[2]).group().lower()
    labels = [(i, int(rng.random() < share[host(u)])) for i, u in pages[:400] if rng.random() < 0.7] + [(3, None)]
    out = reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int"), reputation.ReputationConfig()).collect()
    suffix, domain, own = shrunk([(host(dict(pages)[i]), g) for i, g in labels if g is not None])
    tail = lambda h: (re.search(r"[^.]*\.[^.]*$", h) or re.search(".*", h)).group()
    for r in out:
        h = host(dict(pages)[r.page_id])
        bound = own.get(h, domain.get(tail(h), suffix.get(h.split(".")[-1]))) if h else None
        assert (r.bound is None) == (bound is None) and (bound is None or abs(r.bound - bound) < 2e-6)
        assert r.verdict == ("block" if bound is not None and bound < 0.5 else "allow") and r.rule is None
    assert {r.verdict for r in out} == {"block", "allow"} and len(out) == len(pages)


def test_fingerprints_against_sets(spark):
    """With fewer shingles than a sketch holds, all estimates are exact."""
    rng = random.Random(3)
    rows = [*[r for r in ODD if r[0] != 8], *((50 + i, " ".join(rng.choice(["a", "B", "ü", "d", "e"]) for _ in range(rng.randint(0, 40)))) for i in range(40))]
    out = fingerprints.edit_check(table(spark, rows)).collect()

    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", t.translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    like = lambda a, b: len(a & b) / len(a | b) if a and b else float(len(a) == len(b))
    order = sorted(((d if d is not None else -(1 << 63), t or "") for d, t in rows), reverse=True)
    want = []
    for (d, t), (_, f) in zip(order, order[1:] + order[:1]):
        n = len(t) // 3
        a, b, c = shingles(t), shingles(t[: len(t) - n] + f[:n]), shingles(f)
        want.append((d, len(t), round(like(a, b), 9), round(like(a, c), 9), len(a), round(len(a & b) / len(a) if a else 1.0, 9)))
    got = [(r.doc_id if r.doc_id is not None else -(1 << 63), r.n_chars, round(r.near_edited, 9), round(r.near_next, 9), int(r.n_shingles_est), round(r.contained_in_edited, 9)) for r in out]
    assert sorted(got) == sorted(want)


def test_sketches_merge():
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64) * np.uint64(4)) for n in (3000, 500))
    whole = np.union1d(a, b)
    assert (fingerprints.merge(a[:128], b[:128], 128) == whole[:128]).all()
    assert abs(fingerprints.distinct(whole[:128], 128) / len(whole) - 1) < 0.35
    assert abs(fingerprints.containment(b[:128], whole[:128], 128) - 1) < 0.35 and fingerprints.containment(a[:0], b[:128], 128) == 1.0


def test_mixture_against_a_grid():
    """Expectation-maximisation finds the proportions of greatest likelihood, and a third language stays out."""
    rng = np.random.default_rng(7)
    likes = rng.dirichlet(np.ones(50) * 0.3, 3) + 1e-6
    likes /= likes.sum(axis=1, keepdims=True)
    ids = rng.choice(50, 4000, p=0.7 * likes[0] + 0.3 * likes[2])
    config = language.LanguageConfig(steps=60)
    share = language.LanguageModel(list("abc"), np.log(likes).T.copy()).mixture(ids, config)
    weight = np.bincount(ids, minlength=50)
    grid = max((float(weight @ np.log(x * likes[0] + (1 - x) * likes[2])), x) for x in np.linspace(0.001, 0.999, 999))[1]
    assert share[1] == 0 and abs(share[0] - grid) < 0.01 and abs(share.sum() - 1) < 1e-9


def test_run_length_index():
    """Runs spell the transform of a sorted suffix list; matching statistics equal a search by hand."""
    rng = random.Random(8)
    members = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 25))).encode() for _ in range(12)] + [b"abab" * 6] * 3
    index = RunLengthIndex(members, 4)
    text = b"\xff".join(members) + b"\xff"
    suffixes = sorted(range(len(text)), key=lambda i: (text[i:].split(b"\xff")[0] + b"\x00", i))
    spelled = [text[i - 1] for i in suffixes]
    runs = [(int(c), int(n)) for c, n in zip(index.run_symbol, index.run_length)]
    assert [c for c, n in runs for _ in range(n)] == [(c + 1) % 256 for c in spelled] and len(runs) < len(text)
    patterns = [b"abba", b"ababababab", b"c", b"bbbbbbbbbb", b"aXb", b""]
    got = {}
    for who, offset, row, length in index.stream(patterns):
        for w, o, n in zip(who, offset, length):
            got[int(w), int(o)] = int(n)
    for w, p in enumerate(patterns):
        for o in range(len(p)):
            assert got[w, o] == max(n for n in range(len(p) - o + 1) if not n or any(p[o : o + n] in m for m in members))


def test_fingerprints(spark):
    rows = [*ODD, *((50 + i, f"text {i} of many words that goes on {'abc ' * i}") for i in range(40))]
    out = fingerprints.edit_check(table(spark, rows)).collect()
    assert len(out) == len(rows)
    order = sorted(((d if d is not None else -(1 << 63), t or "") for d, t in rows), reverse=True)
    want = sorted(hashlib.sha256(fingerprints.edited(a[1], b[1]).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1]))
    assert sorted(r.edited_sha256 for r in out) == want
    a, b = (np.unique(np.random.default_rng(s).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)) for s in (1, 2))
    both = np.union1d(a, b)
    assert abs(fingerprints.resemblance(a[:128], both[:128], 128) - len(a) / len(both)) < 0.15
    assert (fingerprints.decode(fingerprints.encode(a[:128])) == a[:128]).all()


def test_next_document_over_many_buckets(spark):
    """near_next against brute force where a partition holds several buckets, not in the order of their ids."""
    text = lambda i: f"text {i // 2} of many words " + " ".join(f"w{i // 2}x{j}" for j in range(30))
    rows = [*ODD, *((100 + i, text(i)) for i in range(120))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = fingerprints.edit_check(table(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(((d if d is not None else -(1 << 63), t or "") for d, t in rows), reverse=True)
    config = fingerprints.SketchConfig()
    s = fingerprints.sketches([t for _, t in order], config)
    near = [fingerprints.resemblance(a, b, config.k) for a, b in zip(s, s[1:] + s[:1])]
    want = sorted((d, fingerprints.encode(a), n) for (d, _), a, n in zip(order, s, near))
    assert sorted((r.doc_id if r.doc_id is not None else -(1 << 63), r.fingerprint, r.near_next) for r in out) == want


def test_a_text_of_six_languages():
    logs = np.log(np.full((6, 6), 0.01) + np.eye(6) * 0.94)
    share = language.LanguageModel(list("abcdef"), logs).mixture(np.repeat(np.arange(6), 200), language.LanguageConfig())
    assert np.allclose(share, 1 / 6, atol=0.01)


def test_reputation_without_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x"), (None, None), (1, "http://a.b/x")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = reputation.judge(pages, labels).collect()
    assert len(out) == 3 and {r.verdict for r in out} == {"allow"} and all(r.bound is None for r in out)
    assert reputation.judge(pages.where("false"), labels).collect() == []
    assert reputation.judge(pages.withColumns({c: F.lit(c) for c in ("host", "path", "domain", "suffix", "salt", "bound", "rule")}), labels).count() == 3


@pytest.mark.parametrize("f", [lambda d: packing.pack(d, packing.PackingConfig(Q.tokenizer_path())), lambda d: mixing.mix(d)[0], lambda d: media.clips(media.write_media(d)), lambda d: language.identify(d, language.fit(d)), lambda d: contextmix.score(d, F.lit(True)), repeats.remove_repeats, fingerprints.edit_check])
def test_empty_tables(spark, f):
    assert f(table(spark, [])).collect() == []
