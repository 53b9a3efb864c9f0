"""The corpus queries that SQL can express, on the smallest tables."""

import os

import pytest

from flowloom.llm import oracles, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_meets_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    sql = con.sql(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES[name]})").fetchall()
    assert sorted(map(str, ([r[c] for c in columns] for r in got.collect()))) == sorted(map(str, map(list, sql)))
