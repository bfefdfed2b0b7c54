"""Runs the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from corvane.plans import queries as P

HEADLINES = ("hybrid_search", "hybrid_search_batch", "lexical_cover_density_topk", "lexical_bm25_topk", "dense_topk", "dense_topk_table", "chunk_documents", "html_to_text_native", "html_to_text_udf", "postings_df", "lexeme_df", "ingest_unzip", "ingest_filings", "ask_prompt")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINES:
        for again in (False, True):  # the first run warms up
            start = time.perf_counter()
            P.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
