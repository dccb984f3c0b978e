"""Every registered query that SQL can state, side by side with DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from proofgrid.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.QUERIES, catalogue.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    key = lambda r: tuple((v is None, f"{v:.6f}" if isinstance(v, float) else str(v)) for v in r)
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=key)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = comparable(df.columns, df.collect())
    if name not in SQL:
        assert got
        return
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    want = comparable(columns, result.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            if isinstance(x, float) or isinstance(y, float):
                assert x == pytest.approx(y, rel=1e-9, abs=2e-9)
            else:
                assert x == y


def test_every_sql_text_has_a_query_and_the_entry_query_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
