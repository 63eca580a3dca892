"""Queries that have SQL, against it, at the smallest scale."""

import duckdb
import pytest

from tapeloom.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    df = QUERIES[name](spark, SMALL)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    mine = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    assert mine == sorted(cur.fetchall(), key=str)
