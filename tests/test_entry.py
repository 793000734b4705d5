import os

import duckdb
import pytest

import __spark_entry__ as entry
from tapeloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, map(tuple, df.collect()))
    want = con.execute(ORACLES[name])
    assert got == rows([d[0] for d in want.description], want.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLES) == set(QUERIES)
    assert entry.entry(spark).limit(1).count() == 1
