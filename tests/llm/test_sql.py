"""Queries of the operators that SQL can express give what DuckDB gives on the supplied tables, where they are there."""

import glob
import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
from convena.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert columns == sorted(want.columns)
    key = lambda rows, names: sorted(str([dict(zip(names, r, strict=True))[c] for c in columns]) for r in rows)
    assert key(map(tuple, df.collect()), df.columns) == key(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0


def test_neighbours_against_exact_sql(spark):
    """Recall of op9 over the whole table, and its scores, against all distances."""
    con = duckdb.connect()
    con.sql(f"CREATE TABLE v AS SELECT vec_id, embedding::DOUBLE[] AS e FROM '{DATA}/embeddings.parquet'")
    want = con.sql("SELECT q.vec_id, c.vec_id, list_distance(q.e, c.e) AS d FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY d, c.vec_id) <= 10").fetchall()
    near = {(q, c): d for q, c, d in want}
    got = queries.op9_nearest(spark, DATA).collect()
    hits = [r for r in got if (r["query_id"], r["vec_id"]) in near]
    assert len(got) == len(want) and len(hits) >= 0.95 * len(want)
    assert all(r["score"] == pytest.approx(near[r["query_id"], r["vec_id"]], rel=1e-9, abs=1e-9) for r in hits)
