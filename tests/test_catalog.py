"""Every registered query against its SQL twin, at the smallest scale."""

import math

import pytest

from codeatlas.plans.catalog import ORACLES, QUERIES

from .conftest import DATA


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return [cell(y) for y in x] if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got is not None
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(cell(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want
