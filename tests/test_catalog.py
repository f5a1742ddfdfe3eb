import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(k for k in entry.catalog.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def tidy(value):
    return round(value, 9) if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", OWN)
def test_query_matches_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(tidy, r)) for r in df.select(columns).collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    run = duck.execute(sql)
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(tidy(r[i]) for i in order) for r in run.fetchall()), key=repr)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists("bench.py")
