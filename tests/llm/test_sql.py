import glob
import os

import duckdb
import pytest

from lectern.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, want = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    key = lambda cols, rows: sorted(repr(tuple(r[cols.index(c)] for c in order)) for r in rows)
    assert key(df.columns, map(tuple, df.collect())) == key(list(want.columns), want.fetchall())
