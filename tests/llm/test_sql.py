"""The queries of this folder that SQL can express, on the smallest tables."""

import os

import duckdb
import pytest

from corpusloom.llm import queries

from ..test_queries import plain

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = con.execute(queries.SQL[name])
    names, cols = [d[0] for d in got.description], sorted(df.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want and want
