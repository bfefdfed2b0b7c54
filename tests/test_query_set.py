import duckdb
import pytest

from corvane.plans import queries as P
from test_oracle import connection, rows

NAMES = ("lexical_and_match", "lexical_cover_density_topk", "lexical_bm25_topk", "dense_topk", "rrf_fusion", "hybrid_search_batch", "asof_leakage_audit", "ask_prompt")


def test_every_hundredth_row_asks(spark):
    sf = "/root/testdata/sf0.01"
    ids = {x for k, t in (("doc_id", "documents"), ("vec_id", "embeddings")) for x, in duckdb.sql(f"select {k} from '{sf}/{t}.parquet' where {k} % 100 = 0").fetchall()}
    assert {r.qid for r in P.table_asked(spark, sf).collect()} == ids
    vectors = {x for x, in duckdb.sql(f"select vec_id from '{sf}/embeddings.parquet' where vec_id % 100 = 0").fetchall()}
    assert {r.qid for r in P.QUERIES["dense_topk_table"](spark, sf).collect()} == vectors


def test_every_passage_asks(spark, sf):
    asked = {r.qid: r.query for r in P.asked(spark, sf).collect()}
    items = {x for x, in duckdb.sql(f"select item_id from '{sf}/benchmark.parquet'").fetchall()}
    assert set(asked) == items | {-1, -2}
    assert not {-1, -2} & {r.qid for r in P.QUERIES["hybrid_search_batch"](spark, sf).collect()}


@pytest.mark.parametrize("name", [n + kind for n in NAMES for kind in ("", "_table")])
def test_larger_table_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    want = rows(connection(sf).sql(P.ORACLE_SQL[name]).df())
    assert rows(P.QUERIES[name](spark, sf).toPandas()) == want and want
