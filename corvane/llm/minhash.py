"""Near-duplicate groups by min-max hashing.

*Signature.*  Of each permutation both the minimum and the maximum over a document's shingles are kept, so
``permutations`` hash evaluations give twice as many sketch values; each agrees between two sets with a
probability of their Jaccard similarity, and the two are (slightly negatively) correlated, which lowers the
variance of banding.  With 96 permutations and bands of 4 values there are 48 bands: a pair at similarity 0.75
shares none of them with probability (1 - 0.75^4)^48, about 1e-8.

*Candidates.*  Equal sets are folded into one first.  A band bucket is then resolved in up to three rounds,
none of which lists all pairs of a bucket:

1. every set meets one leader, that of most of its buckets (bucket leader: the smallest set id);
2. in buckets that still hold several components, sets meet the most central member: the one with the smallest
   share of shingles that no other open set has;
3. what is left apart meets in blocks.  Of the components of a bucket that with most members is its *major* one; sets
   of the others meet all members of the major component, which come once for all their buckets, and each other in
   the bucket.  A block of them is indexed by shingle, the other side streams past it, and overlaps are counted in
   the index, so that no pair becomes a row.  A set takes part if ``|A| - u(A)`` (``u``: shingles that no other open
   set has) still allows the similarity.  That bound is exact, so no link is lost.

Each candidate is confirmed on the full shingle sets, recomputed from whole texts.  Buckets of one component are
closed: a further link in them could not change the result.

Set ids and shingles are 64-bit hashes.  All steps are group-bys, joins and streamed sorted partitions; a leader
with many members is salted, so no task gathers a group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import _kernels as K
from corvane.llm import _rows as R
from corvane.llm._spark import Tables, components


@dataclass(frozen=True)
class MinHashConfig:
    width: int = 5
    #: A link needs ``per_cent * |A | B| <= 100 * |A & B|``.
    per_cent: int = 75
    permutations: int = 96
    rows: int = 4
    seed: int = 7
    #: Members of one leader, or sets that stream past a block, that one task compares.
    salt_rows: int = 500
    #: Shingles of one indexed block.
    block_shingles: int = 1 << 20
    #: Bits of the filter that keeps texts without candidates from being shuffled; a full filter only costs time.
    bloom_bits: int = 1 << 24


def signatures(sets, config: MinHashConfig) -> np.ndarray:
    """(2 * permutations) 32-bit values of one sorted hash set: minima, then maxima."""
    rng = np.random.default_rng(config.seed)
    factor = rng.integers(0, 1 << 32, config.permutations, dtype=np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, config.permutations, dtype=np.uint32)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    low = np.full(config.permutations, 0xFFFFFFFF, np.uint32)
    high = np.zeros(config.permutations, np.uint32)
    for i in range(0, len(x), 2048):
        h = factor[:, None] * x[None, i : i + 2048]
        h += shift[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    values = signature[: len(signature) // rows * rows].reshape(-1, rows).astype(np.uint64)
    h = np.arange(len(values), dtype=np.uint64) * K._SEQ
    for k in range(rows):
        h = K.mix(h ^ values[:, k]) * K._BASE
    return h


def set_id(hashes: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(K.mix(np.array([K.mix(hashes).sum(dtype=np.uint64) ^ np.uint64(len(hashes)) * K._SEQ], np.uint64))[0].astype(np.int64))


def _sign(config: MinHashConfig):
    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            n = np.zeros(batch.num_rows, np.int64)
            sid: list = [None] * batch.num_rows
            bands = np.zeros((0, 0), np.int64)
            keys, sizes = [], np.zeros(batch.num_rows + 1, np.int32)
            for k, hashes in K.document_shingles(data, offsets, config.width):
                n[k] = len(hashes)
                if len(hashes):
                    sid[k] = set_id(hashes)
                    keys.append(band_keys(signatures(hashes, config), config.rows).astype(np.int64))
                    sizes[k + 1] = len(keys[-1])
            bands = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(n), pa.array(sid, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(bands))],
                ["doc_id", "th", "n", "sid", "bands"],
            )

    return run


def _confirm(config: MinHashConfig):
    """Streams partitions sorted by leader, salt and member; the leader's own text comes first."""

    def run(batches):
        at, held = None, None
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            a, b, salt = (batch.column(c).to_pylist() for c in ("a", "b", "salt"))
            out = ([], [], [], [])
            for k, hashes in K.document_shingles(data, offsets, config.width):
                if a[k] is None:
                    at, held = (b[k], salt[k]), hashes
                    continue
                assert at == (b[k], salt[k])
                both = len(np.intersect1d(held, hashes, assume_unique=True))
                either = len(held) + len(hashes) - both
                if 100 * both >= config.per_cent * either:
                    for column, value in zip(out, (a[k], b[k], both, either)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "both", "either"])

    return run


class _Block:
    """Sets indexed by shingle, and which of their components are known to be linked."""

    def __init__(self):
        self.sid: list[int] = []
        self.root: list[int] = []
        self.sets: list[np.ndarray] = []
        self.up: dict[int, int] = {}
        self.shingle = None

    def find(self, root: int) -> int:
        while self.up.setdefault(root, root) != root:
            root = self.up[root]
        return root

    def add(self, sid: int, root: int, hashes: np.ndarray) -> None:
        self.sid.append(sid)
        self.root.append(root)
        self.sets.append(hashes)

    def close(self) -> None:
        self.size = np.array([len(x) for x in self.sets], np.int64)
        every, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.size)
        order = np.argsort(every, kind="stable")
        self.shingle, self.owner, self.sets = every[order], owner[order], []

    def links(self, sid: int, root: int, hashes: np.ndarray, per_cent: int) -> list[int]:
        """Sets of the block that link with this one, one for each component that is not yet linked with its own."""
        if not self.sid:
            return []
        if self.shingle is None:
            self.close()
        lo, hi = np.searchsorted(self.shingle, hashes, "left"), np.searchsorted(self.shingle, hashes, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(self.owner[at], minlength=len(self.size))
        out = []
        for k in np.flatnonzero(100 * both >= per_cent * (self.size + len(hashes) - both)):
            a, b = self.find(root), self.find(self.root[k])
            if a != b:
                self.up[a] = b
                out.append(self.sid[k])
        return out


def _meet(config: MinHashConfig):
    """Streams partitions sorted by group, block and salt, in which a block's indexed sets come before the others."""

    def run(batches):
        at, block = None, _Block()
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            g, i, j, side, sid, root = (batch.column(c).to_pylist() for c in ("g", "block", "salt", "side", "sid", "root"))
            out = ([], [])
            for k, hashes in K.document_shingles(data, offsets, config.width):
                if at != (g[k], i[k], j[k]):
                    at, block = (g[k], i[k], j[k]), _Block()
                if side[k] == 0:
                    block.add(sid[k], root[k], hashes)
                    continue
                for other in block.links(sid[k], root[k], hashes, config.per_cent):
                    out[0].append(sid[k])
                    out[1].append(other)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return run


def _shingle_rows(config: MinHashConfig):
    names = ["h", "sid"]

    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            sid = batch.column("sid").to_numpy()
            found, size = [], 0
            for k, hashes in K.document_shingles(data, offsets, config.width):
                found.append((hashes.view(np.int64), np.full(len(hashes), sid[k])))
                size += len(hashes)
                if size >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names)
                    found, size = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names)

    return run


def _texts(tables: Tables, docs: DataFrame, wanted: DataFrame, config: MinHashConfig) -> DataFrame:
    """(sid, text) of ``wanted`` (sid, th): one text of each set.  A bit filter of fixed size goes before the join."""
    spark = docs.sparkSession
    bit = F.pmod(F.col("th"), F.lit(config.bloom_bits))
    words = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
    found = words.toArrow()
    filled = np.zeros(config.bloom_bits >> 6, np.int64)
    filled[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(filled.view(np.uint64))
    size = config.bloom_bits

    def keep(batches):
        for batch in batches:
            k = np.mod(batch.column("th").to_numpy(), size)
            hit = (shared.value[k >> 6] >> (k & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool)))

    some = docs.where("text is not null").select("th", "text").mapInArrow(keep, "th long, text string")
    return tables.write(some.groupBy("th").agg(F.first("text").alias("text")).join(wanted, "th").select("sid", "text"))


def _links(tables: Tables, pairs: DataFrame, texts: DataFrame, config: MinHashConfig) -> DataFrame:
    """The pairs (a, b) that are links.  Only a's text travels for each pair; b's once for each salt."""
    count = pairs.groupBy("b").agg(F.ceil(F.count("*") / config.salt_rows).cast("long").alias("salts"))
    salted = tables.write(pairs.join(count, "b").select("a", "b", F.pmod("a", "salts").alias("salt")))
    members = salted.join(texts.withColumnRenamed("sid", "a"), "a").select("a", "b", "salt", "text")
    leaders = salted.select("b", "salt").distinct().join(texts.withColumnRenamed("sid", "b"), "b").select(F.lit(None).cast("long").alias("a"), "b", "salt", "text")
    rows = members.unionByName(leaders).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return tables.write(rows.mapInArrow(_confirm(config), "a long, b long, both long, either long"))


def signed(docs: DataFrame, config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """(doc_id, th, n, sid, bands): set size, set id (null if empty) and band keys of each row."""
    return docs.select("doc_id", "text", "th").mapInArrow(_sign(config), T.StructType([docs.schema["doc_id"]]).simpleString()[7:-1].replace(":", " ") + ", th long, n long, sid long, bands array<long>")


def grouped(docs: DataFrame, config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """(doc_id, th, n, root, component_id) for each row of ``docs``; th is the text's hash, root names the component
    and is null for an empty set.
    """
    tables = Tables(docs.sparkSession, "minhash", tidy=False)
    docs = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    rows = tables.write(signed(docs, config))
    # first() of equal sets: the same bands for each
    sets = rows.where("sid is not null").groupBy("sid").agg(F.first("bands").alias("bands"), F.min("th").alias("th"), F.max("n").alias("n"))
    spread = sets.select("sid", F.explode("bands").alias("band"))
    leads = spread.groupBy("band").agg(F.min("sid").alias("lead"), F.count("*").alias("size")).where("size > 1")
    members = tables.write(spread.join(leads, "band").select("band", "sid", "lead"))
    about = rows.where("sid is not null").groupBy("sid").agg(F.min("th").alias("th"), F.max("n").alias("n"))
    about = tables.write(about.join(members.select("sid").distinct(), "sid"))

    root = None
    first = members.where("sid <> lead").groupBy("sid", "lead").count().groupBy("sid").agg(F.max(F.struct("count", "lead")).alias("best"))
    pairs = tables.write(first.select(F.col("sid").alias("a"), F.col("best.lead").alias("b")))
    if pairs.head(1):
        texts = _texts(tables, docs, about.select("sid", "th"), config)
        links = _links(tables, pairs, texts, config)
        root = components(tables, links)
        open_, tested = _open(tables, members, root), pairs
        if open_.head(1):
            facts = _facts(tables, open_, about, texts, config)
            share = F.struct((F.col("u") / F.col("n")).alias("share"), "sid", "root", "n", "u")
            central = open_.join(facts, "sid").groupBy("band").agg(F.min(share).alias("c"))
            met = open_.join(facts, "sid").join(central, "band").where("root <> c.root").where(_allowed("n", "u", "c.n", "c.u", config))
            pairs = met.select(F.greatest("sid", F.col("c.sid")).alias("a"), F.least("sid", F.col("c.sid")).alias("b")).distinct()
            root = _again(tables, pairs, tested, texts, root, config)
            # sets that can link with nothing need no further look; then most buckets are of one component
            can = facts.where(_allowed("n", "u", "n - u", "0", config))
            left = _open(tables, open_.select("band", "sid").join(can.select("sid"), "sid"), root)
            if left.head(1):
                links = _blocks(tables, left, facts, texts, config)
                if links.head(1):
                    root = components(tables, root.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
    if root is None:
        found = rows.where("sid is not null").withColumn("root", F.col("sid"))
    else:
        found = rows.where("sid is not null").join(root.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = found.select("doc_id", "th", "n", "root").join(least, "root").select("doc_id", "th", "n", "root", "component_id")
    return out.unionByName(rows.where("sid is null").select("doc_id", "th", "n", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Null or wordless texts have an empty set: they link with nothing and are kept.  Equal rows, and rows that
    share a doc_id, are one row each; with a null doc_id the component's smallest id counts, and the row is kept
    only if its component has no id.  An empty table gives an empty result.
    """
    out = grouped(docs, config)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id (null comes last), then text hash; of rows
    that are equal in both, any one.  Rows of null or wordless texts all stay.
    """
    found = grouped(docs, config).where("root is not null")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    # keys without nulls: the join's exchange serves the choice among equal rows too
    keys = ["_no", "_id", "_th"]
    key = lambda doc_id, th: (doc_id.isNull().alias("_no"), F.coalesce(doc_id, F.lit(0)).alias("_id"), th.alias("_th"))
    best = found.groupBy("root").agg(F.min(order).alias("m")).select(*key(F.col("m.doc_id"), F.col("m.th")))
    wordy = F.coalesce("text", F.lit("")).rlike(R.WORD)
    named = docs.where(wordy).select("*", *key(F.col("doc_id"), F.xxhash64("text")))
    one = named.join(best, keys, "left_semi").dropDuplicates(keys)
    return one.select(*docs.columns).unionByName(docs.where(~wordy))


def _open(tables: Tables, members: DataFrame, root: DataFrame) -> DataFrame:
    """(band, sid, root) of the buckets that hold more than one component."""
    now = members.select("band", "sid").join(root.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    several = now.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("band")
    return tables.write(now.join(several, "band", "left_semi"))


def _facts(tables: Tables, open_: DataFrame, about: DataFrame, texts: DataFrame, config: MinHashConfig) -> DataFrame:
    """(sid, n, u): set size, and how many of its shingles no other open set has."""
    sids = open_.select("sid").distinct()
    each = texts.join(sids, "sid", "left_semi").mapInArrow(_shingle_rows(config), "h long, sid long")
    alone = each.groupBy("h").agg(F.count("*").alias("c"), F.min("sid").alias("sid")).where("c = 1").groupBy("sid").agg(F.count("*").alias("u"))
    return tables.write(about.select("sid", "n").join(sids, "sid", "left_semi").join(alone, "sid", "left").select("sid", "n", F.coalesce("u", F.lit(0)).alias("u")))


def _allowed(n1: str, u1: str, n2: str, u2: str, config: MinHashConfig):
    most = f"least({n1} - {u1}, {n2} - {u2})"
    return F.expr(f"100 * {most} >= {config.per_cent} * ({n1} + {n2} - {most})")


def _again(tables: Tables, pairs: DataFrame, tested: DataFrame, texts: DataFrame, root: DataFrame, config: MinHashConfig) -> DataFrame:
    seen = tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = tables.write(pairs.join(seen, ["a", "b"], "left_anti"))
    links = _links(tables, pairs, texts, config).select("a", "b")
    if links.head(1):
        root = components(tables, root.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
    return root


def _blocks(tables: Tables, left: DataFrame, facts: DataFrame, texts: DataFrame, config: MinHashConfig) -> DataFrame:
    """Links (a, b) between components that meet in the open buckets ``left`` (band, sid, root).

    Rows grow with the sets and their buckets, times the number of blocks (or salts) of their group.
    """
    major = left.groupBy("band", "root").count().groupBy("band").agg(F.max(F.struct("count", "root")).alias("m"))
    minor = tables.write(left.join(major.select("band", F.col("m.root").alias("major")), "band").where("root <> major"))
    g = lambda kind, key: F.xxhash64(F.lit(kind), F.col(key)).alias("g")
    # against the members of the major component, once for all their buckets
    own = minor.select(g(0, "major"), "sid", "root").distinct()
    rest = left.select("sid", "root").distinct().join(minor.select(F.col("major").alias("root")).distinct(), "root", "left_semi")
    # against each other, in buckets of two minor components at least
    several = minor.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("band")
    each = minor.join(several, "band", "left_semi").select(g(1, "band"), "sid", "root")
    side = lambda df, k: df.select("g", "sid", "root", F.lit(k).alias("side"))
    rows = side(own.unionByName(each), 0).unionByName(side(rest.select(g(0, "root"), "sid", "root").unionByName(each), 1))
    rows = tables.write(rows.join(facts.select("sid", "n"), "sid"))
    size = rows.groupBy("g").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("shingles"), F.count_if(F.col("side") == 1).alias("members"))
    size = size.select("g", F.ceil(F.col("shingles") / config.block_shingles).cast("int").alias("blocks"), F.ceil(F.col("members") / config.salt_rows).cast("int").alias("salts"))
    part = lambda n, seed: F.pmod(F.xxhash64("sid", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = rows.join(size, "g")
    blocks = F.when(F.col("side") == 0, F.array(part("blocks", 1))).otherwise(every("blocks"))
    placed = placed.select("g", "sid", "root", "side", "salts", F.explode(blocks).alias("block"))
    salts = F.when(F.col("side") == 1, F.array(part("salts", 2))).otherwise(every("salts"))
    placed = placed.select("g", "sid", "root", "side", "block", F.explode(salts).alias("salt"))
    met = placed.join(texts, "sid").repartition("g", "block", "salt").sortWithinPartitions("g", "block", "salt", "side")
    return tables.write(met.select("g", "block", "salt", "side", "sid", "root", "text").mapInArrow(_meet(config), "a long, b long"))
