"""Language-model scoring by context-tree weighting.

A text is its lower-cased bytes and one end symbol, the byte 0xFF that UTF-8 lacks.  Bytes are split into binary decisions.  Each node of that decision tree has a context tree over the ``DEPTH`` bytes
before; every context keeps a Krichevsky-Trofimov estimate, and all depths are mixed by
``Pw = (Pe + product of the children's Pw) / 2``.  After training the counts stand still, and a bit's probability is
the mixture of all depths' estimates along its context path.

The tree is held as distinct (``DEPTH`` + 1)-byte grams with their counts, so it grows with the corpus and is never in
one place: grams are grouped by their nearest three context bytes, a group that three bytes bound at 2^24 grams; sums
of log Pw go up to the depths 2, 1 and 0, which have at most 65,793 contexts and are mixed on the driver.  Texts are
scored in buckets of whole documents, each of which meets only the grams that it has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import _kernels as K
from corvane.llm import _rows as R
from corvane.llm._spark import Tables

DEPTH = 5
#: Contexts up to this depth are mixed on the driver.
TOP = 2
_HALF = math.log(0.5)


@dataclass(frozen=True)
class ScoreConfig:
    #: Text bytes of one bucket of documents, and grams of one partition.
    bucket_bytes: int = 12 << 20
    partition_grams: int = 400_000
    #: Prices that one task packs at a time.
    block_rows: int = 1_000_000


#: What stands after each text: the end symbol, and zeros that keep texts out of each other's contexts.
_GAP = b"\xff" + bytes(DEPTH)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the gram that ends at each byte and end symbol, where each text's begin); bytes before a text count as 0."""
    raw = data.tobytes()
    joined = np.frombuffer(_GAP.join([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]) + _GAP, np.uint8)
    out, n = joined.astype(np.int64), 1
    while n <= DEPTH:  # grams of n bytes become grams of up to 2n
        step = min(n, DEPTH + 1 - n)
        out[step:] |= (out[:-step] & ((1 << (8 * n)) - 1)) >> (8 * (n - step)) << (8 * n) if step < n else out[:-step] << (8 * n)
        n += step
    text = np.arange(len(offsets) - 1)
    mark = np.zeros(len(joined) + 1, np.int8)
    mark[offsets[:-1] + text * len(_GAP)] = 1
    mark[offsets[1:] + text * len(_GAP) + 1] = -1
    return out[np.cumsum(mark[:-1], dtype=np.int8) > 0], np.concatenate([[0], np.cumsum(np.diff(offsets) + 1)])


class Lookup:
    """Values by key, by open addressing in one array; every key asked for is there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(2, (2 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        none = -1  # a number that is no key marks free places
        while (keys == none).any():
            none -= 1
        self.key, self.value = np.full(1 << bits, none, np.int64), np.zeros(1 << bits, values.dtype)
        at, todo = self._first(keys), np.arange(len(keys))
        while len(todo):
            free = np.flatnonzero(self.key[at] == none)
            self.key[at[free]] = keys[todo[free]]
            won = self.key[at] == keys[todo]
            self.value[at[won]] = values[todo[won]]
            at, todo = (at[~won] + 1) & self.last, todo[~won]

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._first(keys)
        out, todo = self.value[at], np.flatnonzero(self.key[at] != keys)
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.last
            hit = self.key[at] == keys[todo]
            out[todo[hit]] = self.value[at[hit]]
            at, todo = at[~hit], todo[~hit]
        return out


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each comes."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _log_kt(n: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of (zeros, ones)."""
    lg = np.vectorize(math.lgamma, otypes=[float])
    values, where = np.unique(n, return_inverse=True)
    half = lg(values + 0.5)
    where = where.reshape(n.shape)
    total, at = np.unique(n.sum(axis=1), return_inverse=True)
    return half[where[:, 0]] + half[where[:, 1]] - lg(total + 1.0)[at] - math.log(math.pi)


def _nodes(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context * 256 + node, counts of 0 and 1) at full depth, sorted: one row for each context and decision node."""
    symbol, context = grams & 255, grams >> 8
    keys, ones, weight = [], [], []
    for level in range(8):
        node = (1 << level) | (symbol >> (8 - level))
        keys.append(context << 8 | node)
        ones.append((symbol >> (7 - level)) & 1)
        weight.append(counts)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at * 2 + np.concatenate(ones), np.concatenate(weight), 2 * len(key)).reshape(-1, 2)
    return key, n


@dataclass
class Level:
    key: np.ndarray
    #: Weight of this depth's own estimate, and its probability of a 1.
    own: np.ndarray
    one: np.ndarray


def _level(key: np.ndarray, n: np.ndarray, below: np.ndarray | None) -> tuple[Level, np.ndarray]:
    """The mixing weights of one depth, and log Pw; ``below``: sums of the children's log Pw."""
    pe = _log_kt(n)
    pw = pe if below is None else np.logaddexp(_HALF + pe, _HALF + below)
    own = np.ones(len(key)) if below is None else np.exp(_HALF + pe - pw)
    return Level(key, own, (n[:, 1] + 0.5) / (n.sum(axis=1) + 1.0)), pw


def _parents(key: np.ndarray, n: np.ndarray, pw: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over the contexts of ``depth`` that share their nearest depth - 1 bytes (the low ones)."""
    mask = ((1 << (8 * (depth - 1))) - 1) << 8 | 255
    up, at = np.unique(key & mask, return_inverse=True)
    total = np.stack([np.bincount(at, n[:, i], len(up)) for i in (0, 1)], axis=1)
    return up, total, np.bincount(at, pw, len(up))


def climb(grams: np.ndarray, counts: np.ndarray) -> tuple[dict[int, Level], tuple]:
    """Levels DEPTH..TOP + 1 of whole groups, and the sums for TOP."""
    key, n = _nodes(grams, counts)
    below, levels = None, {}
    for depth in range(DEPTH, TOP, -1):
        levels[depth], pw = _level(key, n, below)
        key, n, below = _parents(key, n, pw, depth)
    return levels, (key, n, below)


def top_levels(key: np.ndarray, n: np.ndarray, below: np.ndarray) -> dict[int, Level]:
    levels = {}
    for depth in range(TOP, -1, -1):
        levels[depth], pw = _level(key, n, below)
        if depth:
            key, n, below = _parents(key, n, pw, depth)
    return levels


def log_probability(grams: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """Natural log of the probability of each gram's last byte after the bytes before it."""
    symbol, context, out = grams & 255, grams >> 8, np.zeros(len(grams))
    for step in range(8):
        node, bit = (1 << step) | (symbol >> (8 - step)), (symbol >> (7 - step)) & 1
        p = np.full(len(grams), 0.5)
        for depth in range(DEPTH, -1, -1):
            level = levels[depth]
            key = (context & ((1 << (8 * depth)) - 1)) << 8 | node
            at = np.minimum(np.searchsorted(level.key, key), max(len(level.key) - 1, 0))
            there = level.key[at] == key if len(level.key) else np.zeros(len(key), bool)
            if not there.any():
                continue
            one = np.where(bit == 1, level.one[at], 1 - level.one[at])
            # an unseen context has no estimates below it either: all of them are 1/2
            p = np.where(there, level.own[at] * one + (1 - level.own[at]) * p, 0.5)
        out += np.log(p)
    return out


def _word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = K.words(data, offsets)
    return K.span_hashes(data, starts, ends).astype(np.int64), first


def _documents(table: pa.Table):
    """(rows, lower-cased bytes, offsets) of runs of whole documents."""
    data, offsets = K.buffers(table.column("text"))
    for i, j in K.chunks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        yield i, j, K.LOWER[data[lo:hi]], offsets[i : j + 1] - lo


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _wanted(table: pa.Table) -> pa.Table:
    """Distinct keys of a bucket with their training counts: kind 0 grams, 1 words, 2 (key 0) ends."""
    learn = table.column("learn").to_numpy()
    parts: dict[int, list] = {0: [], 1: []}
    for i, j, data, offsets in _documents(table):
        grams, begin = _grams(data, offsets)
        words, first = _word_keys(data, offsets)
        for kind, keys, size in ((0, grams, np.diff(begin)), (1, words, np.diff(first))):
            taught = np.repeat(learn[i:j], size)
            rest = _tally(keys[~taught])[0]
            parts[kind] += [_tally(keys[taught]), (rest, np.zeros(len(rest), np.int64))]
            if len(parts[kind]) > 8:  # runs share most keys: few are held at a time
                parts[kind] = [_merged(parts[kind])]
    out = [(np.full(1, 2, np.int32), np.zeros(1, np.int64), np.array([int(learn.sum())], np.int64))]
    for kind, found in parts.items():
        if found:
            key, count = _merged(found)
            out.append((np.full(len(key), kind, np.int32), key, count))
            parts[kind] = []
    kind, key, count = (np.concatenate(x) for x in zip(*out))
    bucket = np.full(len(key), table.column("bucket")[0].as_py(), np.int32)
    return pa.table({"bucket": bucket, "kind": kind, "key": key, "n": count})


def _planes(values: np.ndarray) -> bytes:
    """A column's bytes, all first bytes first: small numbers leave long runs of zeros, which compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _column(planes: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


PRICES = "bucket int, kind int, keys binary, values binary"


def _packed(rows: int):
    """(bucket, kind, key, value, n) as blocks of one bucket and kind: sorted keys by their steps, and their values."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        bucket, kind, key, value, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("bucket", "kind", "key", "value", "n"))
        order = np.lexsort([key, kind, bucket])
        bucket, kind, key, value, n = bucket[order], kind[order], key[order], value[order], n[order]
        edge = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1]), [True]]))
        out = []
        for a, b in zip(edge[:-1], edge[1:]):
            steps = np.diff(key[a:b].view(np.uint64), prepend=np.uint64(0))
            out.append((int(bucket[a]), int(kind[a]), _planes(steps), _planes(n[a:b] if kind[a] else value[a:b])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "kind", "keys", "values"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= rows:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def score(docs: DataFrame, learn, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Scores of each row of ``docs`` (doc_id, text), learning from the rows where the column ``learn`` holds.

    (doc_id, learned, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): ``base_score`` is
    the add-one unigram of words and ends, ``score`` log10 of the tree's probability of the lower-cased bytes and their
    end.  Null and empty texts have one token, the end.  Repeated rows count each; other columns are ignored.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "contextmix")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // config.bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    wanted = tables.write(rows.groupBy("bucket").applyInArrow(_wanted, "bucket int, kind int, key long, n long"))
    known = tables.write(wanted.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    sums = {r["kind"]: (r["n"], r["v"]) for r in known.groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).collect()}
    tokens = sum(sums.get(k, (0, 0))[0] for k in (1, 2))
    distinct = sum(sums.get(k, (0, 0))[1] for k in (1, 2))
    ends = sums.get(2, (0, 0))[0]

    # whole groups of the nearest three context bytes in one partition
    grams = known.where("kind = 0")
    count = grams.count()
    near = F.expr("shiftright(key, 8) & 16777215")
    placed = grams.select("key", "n").repartition(max(1, -(-count // config.partition_grams)), near)

    def gathered(batches):
        found = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def upward(batches):
        key, c = gathered(batches)
        if len(key):
            _, (up, m, below) = climb(key, c)
            yield pa.RecordBatch.from_arrays([pa.array(up), pa.array(m[:, 0]), pa.array(m[:, 1]), pa.array(below)], ["key", "n0", "n1", "below"])

    # at most 65,536 contexts of 255 nodes
    high = placed.where("n > 0").mapInArrow(upward, "key long, n0 double, n1 double, below double").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum(F.round("below", 9).cast("decimal(28,9)")).cast("double").alias("below"))
    high = high.toArrow()
    order = np.argsort(high["key"].to_numpy())
    column = lambda c: high[c].to_numpy()[order]
    top = spark.sparkContext.broadcast(top_levels(column("key"), np.stack([column("n0"), column("n1")], axis=1), column("below")))

    def downward(batches):
        key, c = gathered(batches)
        if len(key):
            taught = c > 0
            levels = dict(top.value) | (climb(key[taught], c[taught])[0] if taught.any() else {d: Level(np.zeros(0, np.int64), np.zeros(0), np.zeros(0)) for d in range(TOP + 1, DEPTH + 1)})
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(log_probability(key, levels), pa.float32())], ["key", "value"])

    priced = placed.mapInArrow(downward, "key long, value float").select(F.lit(0).alias("kind"), "key", "value", F.lit(0).cast("long").alias("n"))
    priced = tables.write(priced.unionByName(known.where("kind = 1").select("kind", "key", F.lit(0).cast("float").alias("value"), "n")))
    tables.drop(known)
    here = wanted.where("kind < 2").select("bucket", "kind", "key").join(priced, ["kind", "key"]).select("bucket", "kind", "key", "value", "n")
    here = tables.write(here.mapInArrow(_packed(config.block_rows), PRICES))
    tables.drop(wanted, priced)
    out = "doc_id long, learned boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    names = [x.split()[0] for x in out.split(", ")]

    def settle(texts: pa.Table, prices: pa.Table) -> pa.Table:
        blocks = {0: ([np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]), 1: ([np.zeros(0, np.uint64)], [np.zeros(0, np.int64)])}
        for kind, keys, values in zip(*(prices.column(c).to_pylist() for c in ("kind", "keys", "values"))):
            blocks[kind][0].append(np.cumsum(_column(keys, np.uint64), dtype=np.uint64))
            blocks[kind][1].append(_column(values, np.int64 if kind else np.float32))
        price, count = (Lookup(np.concatenate(blocks[k][0]).view(np.int64), np.concatenate(blocks[k][1])) for k in (0, 1))
        base = math.log10(tokens + distinct + 1) if tokens else 0.0
        found = []
        for i, j, data, offsets in _documents(texts):
            grams, begin = _grams(data, offsets)
            run = np.concatenate([[0.0], np.cumsum(price(grams), dtype=np.float64)])
            words, first = _word_keys(data, offsets)
            c = count(words)
            logs, seen = np.concatenate([[0.0], np.cumsum(np.log10(c + 1))]), np.concatenate([[0], np.cumsum(c > 0)])
            size, m = np.diff(offsets), np.diff(first) + 1
            own = run[begin[1:]] - run[begin[:-1]]
            unigram = logs[first[1:]] - logs[first[:-1]] + math.log10(ends + 1) - m * base
            kn = seen[first[1:]] - seen[first[:-1]] + (ends > 0)
            found.append((texts.column("doc_id").slice(i, j - i).to_pylist(), texts.column("learn").slice(i, j - i).to_pylist(), size, m, kn, np.full(j - i, tokens), unigram, own / math.log(10) + 0.0, np.where(size > 0, -own / math.log(2) / np.maximum(size, 1), 0.0)))
        columns = [[x for part in c for x in (part.tolist() if hasattr(part, "tolist") else part)] for c in zip(*found)] if found else [[]] * len(names)
        types = [pa.int64(), pa.bool_(), *[pa.int64()] * 4, *[pa.float64()] * 3]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return rows.groupBy("bucket").cogroup(here.groupBy("bucket")).applyInArrow(settle, out)
