"""Operators' queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from tarn.llm import queries as q

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_vector_codes"])
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    got = q.queries()[name](spark, DIR)
    found = con.execute(q.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())
