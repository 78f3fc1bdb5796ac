"""Every registered query of the engine against its SQL."""

import math

import duckdb
import pytest

from tarn import function_queries, retrieval_queries  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark labels conversations".split()


def cell(v):
    if v is None or v != v:
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(retrieval_queries.queries()))
def test_query(spark, db, name):
    df = retrieval_queries.queries()[name](spark, DIR)
    rows = df.collect()
    sql = retrieval_queries.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(cell(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    got = sorted((tuple(cell(r[c]) for c in sorted(names)) for r in rows), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-5)) for x, y in zip(a, b)), (a, b)
