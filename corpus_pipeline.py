"""The training-data pipeline: stages over ``documents``, each written as Parquet and reread.

All stages take any rows: null, empty and repeated texts and ids, further columns under any name, and an empty table.
All but the last return the columns of their input, in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import _rows as R
from corvane.llm import language, minhash, mixing, packing, repeats
from corvane.llm._spark import Tables
from corvane.llm.queries import tokenizer_path


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with those of its columns renamed that an operator has names for, and how a result gets its columns."""
    own = [c for c in docs.columns if c.lower() in names]
    new = dict(zip(own, R.fresh([*docs.columns, *names], *(f"own_{c}" for c in own))))
    return docs.withColumnsRenamed(new), lambda out: out.select(*[F.col(f"`{new.get(c, c)}`").alias(c) for c in docs.columns])


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID.  Texts that are null or have no letter go, and those whose main language has under half of them.

    Rows are judged one by one, so repeated rows stay or go together; without any labelled row all go.
    """
    docs, own = _aside(docs, "lang_pred", "score", "langs")
    found = language.identify(docs, language.fit(language.training_rows(docs)))
    return own(found.where("lang_pred <> 'und' and score >= 0.5"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Min-max hashing.  One row of each near-duplicate group stays: that with the smallest id (null comes last), then
    text hash; of equal rows any one.  Rows without words are in no group and stay.
    """
    docs, own = _aside(docs, "_no", "_id", "_th")
    return own(minhash.representatives(docs))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Run-length index.  Bytes of long strings that also start earlier go; documents of nothing else go too.

    Where a cut falls inside a character, its bytes that are left go as well.  Rows of one id and text are one document
    and keep the same.  Null and empty texts go.
    """
    docs, own = _aside(docs, "removed", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
    out = repeats.remove_repeats(docs).where("n_bytes > n_removed")
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, repeats.whole_characters("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return own(out)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Source mix.  Each row comes as often as the mix takes it, to the nearest whole copy; a null source is one too.

    Rows are counted one by one, whatever their ids; rows without words are never taken.
    """
    docs, own = _aside(docs, "_row", "copies", "_copy", "size", "source_size", "target", "taken")
    # written once, so that a row has the same number in both branches of the join
    docs = Tables(spark, "mixed").write(docs.withColumn("_row", F.monotonically_increasing_id()))
    taken = mixing.mix(docs, keep=("_row",))[0].where("size > 0").select("_row", F.floor((F.col("taken") + F.expr("size div 2")) / F.col("size")).cast("int").alias("copies"))
    many = docs.join(taken.where("copies > 0"), "_row")
    return own(many.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all that is left: a row for each piece.  Null texts count as empty; equal rows are packed each."""
    return packing.pack(docs, packing.PackingConfig(tokenizer_path()))


STAGES: list = [("language ID", identified), ("MinHash near-dedup", deduplicated), ("suffix-array dedup", without_repeats), ("mixing sources", mixed), ("best-fit packing", packed)]

#: The stages train models and tokenise: no SQL for their rows; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "pipeline")
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = tables.write(stage(spark, docs, sf_dir))
        if k:
            tables.drop(before)
        before = docs
    return docs
