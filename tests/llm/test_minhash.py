import random
import re

import duckdb
import pytest

from corvane.llm import minhash
from corvane.llm._spark import Tables, components
from corvane.llm.minhash import MinHashConfig, near_duplicates

SCHEMA = "doc_id long, text string, lang string, kept string"


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            if 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(s), least.get(find(i)), d == least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows, config=MinHashConfig()):
    df = spark.createDataFrame([(d, t, None, "clash") for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in near_duplicates(df, config).collect()), key=str)


def test_small_cases(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(9, base), (3, base.upper()), (5, base + " extra"), (7, None), (8, ""), (10, " \t\n"), (11, "a b"), (12, "A  B"), (13, "é b"), (None, base), (None, None), (20, "x " * 30000), (3, base.upper()), (21, "z z z z z"), (22, "z z z z z z")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_chained_near_copies(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(8):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 160))]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    assert run(spark, rows) == brute(rows)


def families(seed, groups, copies, edits):
    """Near copies whose edits come from few words, so that edited places agree by chance."""
    rng = random.Random(seed)
    vocab, few, rows = [f"w{i}" for i in range(900)], ["aa", "bb", "cc"], []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(40, 120))]
        for _ in range(copies):
            words = list(base)
            for at in rng.sample(range(len(base)), rng.randint(0, edits)):
                words[at] = rng.choice(few)
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("config", [MinHashConfig(), MinHashConfig(salt_rows=7, block_shingles=300)])
def test_blocks_and_salts(spark, config):
    """Groups with many sets apart, whole and cut into many blocks and salts."""
    rows = [*families(3, 5, 60, 9), *((1000 + i, t) for i, t in families(4, 3, 60, 9))]
    assert run(spark, rows, config) == brute(rows)


def test_rows_are_linear_in_a_group(spark, monkeypatch):
    """Four times the near copies of one group give about four times the rows that meet, not sixteen."""
    made = []
    old = minhash._meet
    met = spark.sparkContext.accumulator(0)

    def seen(config):
        inner = old(config)

        def run(batches):
            def tally():
                for b in batches:
                    met.add(b.num_rows)
                    yield b

            yield from inner(tally())

        return run

    monkeypatch.setattr(minhash, "_meet", seen)
    links = minhash._links

    def pairs(tables, p, texts, config):
        made[-1] += p.count()
        return links(tables, p, texts, config)

    monkeypatch.setattr(minhash, "_links", pairs)
    for copies in (1250, 5000):
        made.append(0)
        met.value = 0
        run(spark, families(9, 1, copies, 10))
        made[-1] += met.value
    assert made[1] <= 7 * made[0] and made[1] < 60 * 5000


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for x in list(parent) if any(x in e and e[0] != e[1] for e in edges)}
    got = components(Tables(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_all_pairs(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    rows = duckdb.sql(f"select doc_id, text from '{path}'").fetchall()
    got = sorted((tuple(r) for r in near_duplicates(spark.read.parquet(path)).collect()), key=str)
    assert got == brute(rows)
