"""Every query with SQL returns the SQL's rows on the smallest tables, where these are there."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr([value(r[i]) for i in order]) for r in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected = con.sql(entry.oracle_sql()[name])
    found = entry.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(map(tuple, found.collect()), found.columns) == rows(expected.fetchall(), expected.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).columns == ["y", "x", "bal", "size"]
