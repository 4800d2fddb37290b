"""Queries that have SQL give DuckDB's rows."""

import os

import pytest

from ploidyflow.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    import duckdb

    c = duckdb.connect()
    for table in os.listdir(FOLDER):
        c.execute(f"create view {table.split('.')[0]} as select * from '{FOLDER}/{table}'")
    got = queries.QUERIES[name](spark, FOLDER)
    want = c.execute(queries.ORACLE_SQL[name])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
