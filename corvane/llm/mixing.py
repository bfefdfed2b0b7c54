"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``i`` takes the golden-ratio point ``frac(i * phi)``, mapped through the sources' cumulative targets; its rank
among its source's slots names the block of words that it takes.  A source's documents, in a shuffled order that
depends on their content only, form one stream of words that is read at most twice; blocks are equal runs of it.
The last block of a source ends at its target, so that the words taken equal the target to within one word.

One row for each source is held on the driver (a mix names its sources).  Prefix sums over a source's documents, and
ranks over its slots, are two-level: over buckets first, then inside each, so a source with most rows is spread.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import _rows as R
from corvane.llm._spark import Tables


@dataclass(frozen=True)
class MixConfig:
    #: Weights of the sources in code point order, repeating; null comes last.
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    passes: int = 2
    block_words: int = 1024
    seed: int = 11
    #: Documents of one source that one task sorts.
    bucket_rows: int = 2_000


def targets(sizes: list[tuple[str | None, int]], config: MixConfig) -> dict[str | None, float]:
    """Words to take of each source: its weighted share, stopped at ``passes`` times its size, the excess reshared."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    weight = {s: config.weights[i % len(config.weights)] for i, (s, _) in enumerate(order)}
    most = {s: float(config.passes * n) for s, n in order}
    total, out, free = config.share * sum(n for _, n in order), {}, list(most)
    while free:
        unit = max(total - sum(out.values()), 0.0) / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most[s]]
        for s in over or free:
            out[s] = most[s] if over else unit * weight[s]
        free = [s for s in free if s not in over] if over else []
    return out


def _before(df: DataFrame, tables: Tables, group: list[str], bucket: str, order: list, amount: str) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` of all earlier rows of the group, in order of bucket, then ``order``."""
    sums = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_sum"))
    upto = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = tables.write(sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_base")))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return local.join(sums, [*group, bucket]).withColumn("before", (F.col("_base") + F.col("_local")).cast("long")).drop("_base", "_local")


def mix(docs: DataFrame, config: MixConfig = MixConfig(), keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, schedule) of ``docs`` (doc_id, text, source; other columns are ignored).

    documents: doc_id, size, source, source_size, target, taken and the columns ``keep`` of the input, one row for
    each row of ``docs``.
    schedule: slot (a few numbers stay unused), rank (of the slot in its source), source, doc_id, first and last word (exclusive) of the part.
    Null or empty texts have size 0 and are never taken; a null source is a source; equal rows share their part in
    either order; an empty table gives empty results.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "mixing")
    shuffled = F.xxhash64("doc_id", "text", F.lit(config.seed))
    sized = tables.write(docs.select("doc_id", "source", *keep, R.word_count(F.col("text")).alias("size"), shuffled.alias("h")))
    facts = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()  # one row for each source
    if not facts:
        empty = sized.select("doc_id", "size", "source", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("taken"), *keep)
        return empty, sized.select(F.col("size").alias("slot"), F.col("size").alias("rank"), "source", "doc_id", F.col("size").alias("first"), F.col("size").alias("last"))
    goal = targets([(r["source"], r["n"]) for r in facts], config)
    order = sorted(goal, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    number = {s: i for i, s in enumerate(order)}
    size_of = {r["source"]: r["n"] for r in facts}
    words = {s: min(round(goal[s]), config.passes * size_of[s]) for s in order}
    blocks = {s: -(-words[s] // config.block_words) for s in order}
    total, edge, cut = sum(blocks.values()), 0.0, []
    for s in order:
        edge += blocks[s] / max(total, 1)
        cut.append(edge)
    table = spark.createDataFrame([(number[s], s, size_of[s], float(goal[s]), words[s], blocks[s]) for s in order], "k int, source string, source_size long, target double, words long, blocks long")
    buckets = max(1, -(-max(r["rows"] for r in facts) // config.bucket_rows))
    # the table has one row for each source, held on the driver above
    stream = sized.join(F.broadcast(table.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    bucket = F.floor((F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))) * buckets).cast("int")
    stream = tables.write(_before(stream.withColumn("bucket", bucket), tables, ["k"], "bucket", [F.shiftrightunsigned("h", 1), "h", "doc_id", "size"], "size"))

    # the schedule: slots, their sources, and ranks from prefix counts over runs of slots
    run = 1 << 16
    slots = spark.range(total + 1).where(F.col("id") < total).select(F.col("id").alias("slot"))
    point = F.pmod(F.col("slot") * F.lit(0.6180339887498949), F.lit(1.0))
    source = F.lit(len(order) - 1)
    for i in range(len(order) - 2, -1, -1):
        source = F.when(point < cut[i], i).otherwise(source)
    slots = slots.select("slot", source.cast("int").alias("k"), F.expr(f"slot div {run}").alias("run"), F.lit(1).alias("one"))
    ranked = _before(slots, tables, ["k"], "run", ["slot"], "one").select("slot", "k", F.col("before").alias("rank"))
    ranked = tables.write(ranked)
    had = {r["k"]: r["n"] for r in ranked.groupBy("k").agg(F.count("*").alias("n")).collect()}  # one row for each source
    # the points' discrepancy leaves a source a few slots short; those follow at the end
    short = [(total + i, number[s], rank) for i, (s, rank) in enumerate((s, rank) for s in order for rank in range(had.get(number[s], 0), blocks[s]))]
    ranked = ranked.unionByName(spark.createDataFrame(short, "slot long, k int, rank long"))

    b, n = config.block_words, F.col("source_size")
    passes = F.explode(F.sequence(F.lit(0), F.lit(config.passes - 1)))
    parts = stream.where("size > 0").select("*", passes.alias("pass"))
    parts = parts.withColumn("lo", F.col("pass") * n + F.col("before")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("words"))).where("lo < hi")
    parts = parts.select("*", F.explode(F.expr(f"sequence(lo div {b}, (hi - 1) div {b})")).alias("rank"))
    parts = parts.withColumn("first", F.greatest("lo", F.col("rank") * b) - F.col("lo")).withColumn("last", F.least("hi", (F.col("rank") + 1) * b) - F.col("lo"))
    schedule = parts.join(ranked, ["k", "rank"]).select("slot", "rank", "source", "doc_id", "k", "before", "first", "last")
    taken = schedule.groupBy("k", "before").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    full = stream.where("size > 0").join(taken, ["k", "before"], "left")
    rows = full.unionByName(stream.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    out = rows.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *keep)
    return out, schedule.drop("k", "before")
