import os

import duckdb
import pytest

from tapeloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    df = QUERIES[name](spark, sf)
    want = con.execute(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
