"""Every query that has SQL agrees with it on the smallest tables."""

import os

import duckdb
import pytest

from quarrystone.plans import registry
from quarrystone.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def checker():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees(spark, checker, name):
    found = QUERIES[name](spark, SF)
    wanted = checker.sql(SQL[name])
    cols = sorted(found.columns)
    assert cols == sorted(wanted.columns)
    at = [list(wanted.columns).index(c) for c in cols]
    a = sorted((tuple(plain(r[c]) for c in cols) for r in found.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in wanted.fetchall()), key=repr)
    assert a == b
