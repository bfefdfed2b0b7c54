"""Empty tables, and further columns under the operators' own names, through every stage and the whole run."""

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

CLASHES = ("did", "th", "root", "band", "lang_pred", "score", "langs", "_no", "_id", "_th", "removed", "n_bytes", "n_removed", "n_spans", "kept", "KEPT_SHA256", "spans", "gone", "_row", "copies", "_copy", "size", "source_size", "target", "taken", "k", "before", "own_score")


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_empty_table(spark, sf, name, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    out = stage(spark, docs, sf)
    assert out.count() == 0
    if name != P.STAGES[-1][0]:
        assert out.columns == docs.columns


def test_run_of_an_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_stay(spark, sf):
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    docs = plain.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in CLASHES})
    for name, stage in P.STAGES:
        out, want = P.Tables(spark, "odd").write(stage(spark, docs, sf)), P.Tables(spark, "odd").write(stage(spark, plain, sf))
        if name == P.STAGES[-1][0]:
            assert out.count() == want.count()
            break
        assert out.columns == docs.columns
        assert out.where(" or ".join(f"`{c}` is null or `{c}` <> concat('{c} of ', doc_id)" for c in CLASHES)).count() == 0
        key = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
        assert key(out) == key(want)
        docs, plain = out, want


@pytest.mark.parametrize("text", [None, "", " \t", "12 !"])
def test_rows_without_text(spark, sf, text):
    docs = spark.createDataFrame([(i, text, "en", "s", 0) for i in (1, 1, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert P.identified(spark, docs, sf).count() == 0
    assert P.deduplicated(spark, docs, sf).count() == (1 if text == "12 !" else 3)
    assert P.without_repeats(spark, docs, sf).count() == (0 if not text else 3)
    assert P.mixed(spark, docs, sf).count() == (5 if text == "12 !" else 0)  # 4, 4 and 1 of 2 words, to whole copies
    assert P.packed(spark, docs, sf).count() == 3
