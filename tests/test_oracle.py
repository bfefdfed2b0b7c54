import duckdb
import pandas as pd
import pytest

from corvane.plans import queries as P

TABLES = "customer orders documents embeddings pages benchmark labels conversations events".split()


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]

    def one(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NaT or x is pd.NA:
            return ""
        if isinstance(x, float):
            return f"{x:.5f}" if x != int(x) else str(int(x))
        return str(x)[:10] if isinstance(x, pd.Timestamp) else str(x)

    return sorted([tuple(one(v) for v in r) for r in df.itertuples(index=False, name=None)])


def connection(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(P.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    want = connection(sf).sql(P.ORACLE_SQL[name]).df()
    got = P.QUERIES[name](spark, sf).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want)
    assert len(want) or name == "embedding_backlog"


@pytest.mark.parametrize("name", sorted(set(P.QUERIES) - set(P.ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert P.QUERIES[name](spark, sf).count() > 0
