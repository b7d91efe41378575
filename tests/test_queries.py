"""Each registered query against its SQL twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from fieldloom.plans import files  # noqa: F401  adds its queries
from fieldloom.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(([plain(r[i]) for i in order] for r in data), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DIR)
    data = rows(got.columns, map(tuple, got.collect()))
    if name not in SQL:
        assert data
        return
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert data == rows(want.columns, want.fetchall())
