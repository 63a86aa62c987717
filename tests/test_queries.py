"""Every registered trade query equals its checking SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quaystone.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(columns), sorted([text(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLES[name])
    assert canon(df.columns, df.collect()) == canon([d[0] for d in want.description], want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
