"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from planespark.jobs import registry

SF = "/root/testdata/sf0.001"


def values(rows):
    return sorted(tuple(str(round(x, 6) + 0.0 if isinstance(x, float) else x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert values(got.select(*columns).collect()) == values([tuple(r[i] for i in at) for r in want.fetchall()])
