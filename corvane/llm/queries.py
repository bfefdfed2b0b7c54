"""The operators' queries for the driver: name to (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import _rows as R
from corvane.llm import contextmix, fingerprints, language, lines, media, minhash, mixing, packing, repeats, reputation


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir), packing.PackingConfig(tokenizer_path()))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_lines(_table(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_units", "n_removed", "chars_removed", "kept_sha256")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.clips(media.write_media(_table(spark, sf_dir)))
    return out.withColumn("n_clips", F.size("clips")).drop("clips", "error")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir)
    model = language.fit(language.training_rows(docs))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (R.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", F.size("langs").alias("n_langs"))


def op6_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contextmix.score(_table(spark, sf_dir), R.remainder(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir))[0].select("doc_id", "size", "source_size", "target", "taken")


def op8_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir).select("doc_id", "text")
    return repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_check(_table(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_packing, op3_lines, op4_media, op5_language, op6_scoring, op7_mixing, op8_reputation, op9_repeats, op10_fingerprints)}

#: SQL for the queries that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    # a private-use character marks where a unit ends: after a stop and white space, or after a newline
    "op3_lines": r"""
WITH cut AS (
    SELECT doc_id, string_split(replace(regexp_replace(coalesce(text, ''), '([.!?])([ \t]+)', '\1\2' || chr(57344), 'g'), chr(10), chr(10) || chr(57344)), chr(57344)) AS u
    FROM documents
), units AS (
    SELECT doc_id, unnest(u) AS unit, generate_subscripts(u, 1) AS pos FROM cut
), named AS (
    SELECT *, trim(translate(regexp_replace(unit, '[\x20\x09-\x0D]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS norm FROM units
), sized AS (
    SELECT *, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS w FROM named
), summed AS (
    SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM sized
), runs AS (
    SELECT a.doc_id, a.pos AS lo, b.pos AS hi
    FROM (SELECT doc_id, pos, upto - w + 20 AS need FROM summed WHERE w > 0) a
    ASOF JOIN (SELECT doc_id, pos, upto FROM summed WHERE w > 0) b ON a.doc_id = b.doc_id AND a.need <= b.upto
), texts AS (
    SELECT r.doc_id, lo, hi, string_agg(norm, ' ' ORDER BY pos) AS run
    FROM runs r JOIN named n ON n.doc_id = r.doc_id AND n.pos BETWEEN lo AND hi AND norm <> '' GROUP BY ALL
), ranked AS (
    SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY run ORDER BY doc_id, lo) AS n FROM texts
), gone AS (
    SELECT DISTINCT u.doc_id, u.pos FROM ranked r JOIN units u ON u.doc_id = r.doc_id AND u.pos BETWEEN lo AND hi WHERE n > 1
)
SELECT u.doc_id, count(*) AS n_units, count(g.pos) AS n_removed,
       coalesce(sum(length(unit)) FILTER (g.pos IS NOT NULL), 0)::BIGINT AS chars_removed,
       sha256(coalesce(string_agg(unit, '' ORDER BY u.pos) FILTER (g.pos IS NULL), '')) AS kept_sha256
FROM units u LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.pos = u.pos GROUP BY u.doc_id
"""
}
