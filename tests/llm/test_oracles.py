"""Queries of the training-data operators with SQL, held against DuckDB."""

import duckdb
import pytest

from verdigraph.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df, want = QUERIES[name](spark, SF), c.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)
