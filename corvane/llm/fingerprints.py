"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ``k`` smallest distinct 64-bit shingle hashes, with the set's size when it has fewer.  Sketches merge
(the k smallest of the union), and two of them estimate resemblance, containment and distinct counts.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import _kernels as K
from corvane.llm import _rows as R
from corvane.llm._spark import Tables


@dataclass(frozen=True)
class SketchConfig:
    width: int = 5
    k: int = 128


def merge(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int) -> float:
    """Estimated size of the set; exact while the sketch is not full."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Share of the union's k smallest hashes that both have.  Two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1]) / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    r, n = resemblance(a, b, k), distinct(merge(a, b, k), k)
    return min(1.0, r * n / max(distinct(a, k), 1.0))


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def sketches(texts: list[str], config: SketchConfig) -> list[np.ndarray]:
    data, offsets = K.buffers(pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()))
    out: list = [None] * len(texts)
    for i, hashes in K.document_shingles(data, offsets, config.width):
        out[i] = hashes[: config.k].copy()
    return out


def fingerprints(docs: DataFrame, config: SketchConfig = SketchConfig()) -> DataFrame:
    """(doc_id, fingerprint) for each row of ``docs``; null and wordless texts have an empty sketch."""

    def run(batches):
        for batch in batches:
            found = [encode(s) for s in sketches(R.strings(batch.column("text")), config)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles_est double, contained_in_edited double"


def with_neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(bucket, ord, doc_id, text, lead): rows in buckets of descending doc_id, each followed by the row after its last.

    Equal ids follow each other by text; a null id comes after all others.  ``lead`` rows repeat the first row of
    the next bucket (of the first bucket, at the end), so that every row's successor stands in its own bucket.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "fingerprints")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("ord", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(rows.agg(F.percentile_approx("ord", [i / n for i in range(1, n)], 10000)).first()[0] or []))
    bucket = F.lit(0)
    if cuts:
        bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= F.col("ord")))
    rows = rows.withColumn("bucket", bucket)  # 0 holds the largest ids
    # one row for each bucket
    heads = tables.write(rows.groupBy("bucket").agg(F.max(F.struct("ord", "text")).alias("head")))
    order = Window.orderBy("bucket")
    after = heads.select("bucket", F.lead("bucket").over(order).alias("next"), F.first("bucket").over(order).alias("first"))
    after = after.select("bucket", F.coalesce("next", "first").alias("next"))
    lead = after.join(heads.withColumnRenamed("bucket", "next"), "next").select("bucket", F.col("head.ord").alias("ord"), F.lit(None).cast("long").alias("doc_id"), F.col("head.text").alias("text"), F.lit(True).alias("lead"))
    both = rows.select("bucket", "ord", "doc_id", "text", F.lit(False).alias("lead")).unionByName(lead)
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "lead", F.desc("ord"), F.desc("text"))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def edit_check(docs: DataFrame, config: SketchConfig = SketchConfig()) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    Null texts count as empty.  One row for each row of ``docs``; an empty table gives none; other columns are ignored.
    """

    def pairs(batches):
        held = None
        for batch in batches:
            out: list = []
            for bucket, doc_id, text, lead in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "lead"))):
                if held is not None:
                    assert held[0] == bucket
                    out.append((*held, text))
                held = None if lead else (bucket, doc_id, text)
            if out:
                yield out

    def run(batches):
        for rows in pairs(batches):
            i = 0
            while i < len(rows):
                j, size = i, 0
                while j < len(rows) and (j == i or size < 1 << 20):
                    size += len(rows[j][2])
                    j += 1
                part = rows[i:j]
                changed = [edited(t, f) for _, _, t, f in part]
                s = sketches([t for _, _, t, _ in part], config)
                e = sketches(changed, config)
                # the next tuple is the next document inside a bucket only; edges sketch the text that follows them
                edges = [m for m, x in enumerate(part) if m + 1 == len(part) or part[m + 1][0] != x[0]]
                f = s[1:] + s[:1]
                for m, z in zip(edges, sketches([part[m][3] for m in edges], config)):
                    f[m] = z
                k = config.k
                out = [
                    (d, len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), encode(a), encode(b), resemblance(a, b, k), resemblance(a, z, k), distinct(a, k), containment(a, b, k))
                    for (_, d, t, _), c, a, b, z in zip(part, changed, s, e, f)
                ]
                names = [x.split()[0] for x in OUT.split(", ")]
                types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                i = j

    return with_neighbours(docs).select("bucket", "doc_id", "text", "lead").mapInArrow(run, OUT)
