"""Every registered query with SQL gives what DuckDB gives on the supplied tables, where they are there."""

import glob
import math
import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
from convena.plans.queries import ORACLE, QUERIES  # noqa: E402

#: Queries that SQL can't express, and the tests that hold them against a brute-force version.
OWN_TESTS = {"duplicate_pairs": "test_duplicates.py"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, views, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert df.columns and os.path.exists(os.path.join(os.path.dirname(__file__), OWN_TESTS[name]))
        return
    want = views.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
