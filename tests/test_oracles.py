"""Every registered query that has SQL gives the same rows as it, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001")
SQL = {k: v for k, v in entry.oracle_sql().items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (bool, int, str)) else float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    theirs = sorted((tuple(plain(v) for v in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert len(mine) == len(theirs)
    assert mine == theirs


def test_every_query_without_sql_runs(spark):
    for name, run in entry.queries().items():
        if name not in SQL and not name.startswith(("op", "pipeline")):
            assert run(spark, DATA).count() >= 0, name
    assert entry.entry(spark).count() > 0
