"""Every relational query against its SQL on an independent engine, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from lectern import plans

from .conftest import SMALL

ORACLE = plans.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def key(row):
    return tuple((v is not None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    df = plans.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    rel = duck.sql(ORACLE[name])
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert sorted(rel.columns) == columns
    assert got == want


def test_entry_points():
    import __spark_entry__ as entry

    assert set(plans.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
