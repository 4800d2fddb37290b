"""Every registered query runs, and those with SQL give DuckDB's rows."""

import os

import pytest

from ploidyflow import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, FOLDER)
    rows = sorted((tuple(r[c] for c in sorted(got.columns)) for r in got.collect()), key=str)
    if name in queries.ORACLE_SQL:
        cursor = duck.execute(queries.ORACLE_SQL[name])
        columns = [d[0] for d in cursor.description]
        order = sorted(range(len(columns)), key=lambda k: columns[k])
        assert sorted(columns) == sorted(got.columns)
        assert rows == sorted((tuple(r[k] for k in order) for r in cursor.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:2] == ["chrom", "pos"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
