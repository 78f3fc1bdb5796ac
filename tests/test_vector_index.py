"""The approximate index, near misses of many names, and searches for many queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import lookup, vector_index, vectors
from tarn.plans import batch

SCHEMA = "vec_id long, embedding array<float>"


def clustered(spark, n=1500, dims=24, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(30, dims))
    rows = [(k, (middle[k % 30] + 0.3 * rng.normal(size=dims)).tolist()) for k in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, [1.0]), (n + 2, [None] * dims), (n + 3, [float("nan")] * dims), (n + 4, [0.0] * dims)], SCHEMA)


def asked(rows, where):
    return rows.where(where).select(F.col("vec_id").alias("query_id"), "embedding")


def test_recall_and_how_little_is_looked_at(spark):
    rows = clustered(spark)
    fitted = vector_index.fit(rows)
    codes, q = vector_index.coded(rows, fitted).cache(), asked(rows, "vec_id % 50 = 0")
    assert codes.count() == 1501  # the usable ones and the zero vector
    found = vector_index.nearest(codes, rows, fitted, q, 10)
    got = vector_index.recall(found, vectors.nearest(rows, q, 10)).first()
    assert got.n_queries == 30 and got.recall >= 0.9
    assert fitted.probes < len(fitted.centroids) / 2  # clusters are found
    exact = {(r.query_id, r.vec_id): round(r.distance, 9) for r in vectors.nearest(rows, q, 1500).collect()}
    assert all(round(r.distance, 9) == exact[r.query_id, r.vec_id] for r in found.collect())


def test_recall_of_vectors_that_do_not_cluster(spark):
    """With a byte of a code for four numbers 0.81 were found here."""
    v = np.random.default_rng(5).normal(size=(12_000, 64)).astype(np.float32)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], SCHEMA).repartition(6)
    fitted, q = vector_index.fit(rows, lists=4), asked(rows, "vec_id % 200 = 0")
    found = vector_index.nearest(vector_index.coded(rows, fitted), rows, fitted, q, 10, probes=4, refined=4)
    assert vector_index.recall(found, vectors.nearest(rows, q, 10)).first().recall >= 0.97


def test_copies_and_many_blocks(spark, monkeypatch):
    """Groups of copies larger than the candidates, more queries than a block, more rows than a block."""
    monkeypatch.setattr(vectors, "QUERIES", 7)
    monkeypatch.setattr(vectors, "ROWS", 50)
    monkeypatch.setattr(vector_index, "CODES", 100)
    v = np.random.default_rng(2).normal(size=(60, 8)).astype(np.float32)
    v[1] = v[0] * 2  # another vector of the same direction
    which = [k % 60 if k % 3 else 5 for k in range(900)]
    rows = spark.createDataFrame([(k, v[x].tolist()) for k, x in enumerate(which)], SCHEMA).repartition(3)
    q = asked(rows, "vec_id % 20 = 0")
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    d = np.round(1 - unit @ unit.T, 12)
    want = {(k, x) for k in range(0, 900, 20) for x in sorted(range(900), key=lambda x: (d[which[k], which[x]], x))[:4]}
    assert {(r.query_id, r.vec_id) for r in vectors.nearest(rows, q, 4).collect()} == want
    fitted = vector_index.fit(rows)
    got = vector_index.nearest(vector_index.coded(rows, fitted), rows, fitted, q, 4, probes=len(fitted.centroids)).collect()
    assert {(r.query_id, r.vec_id) for r in got} == want


def test_queries_without_direction_find_nothing(spark):
    rows = clustered(spark, 300)
    fitted = vector_index.fit(rows)
    odd = asked(rows, "vec_id >= 298").unionByName(spark.createDataFrame([(1000, []), (1001, [2.0])], "query_id long, embedding array<float>"))
    found = vector_index.nearest(vector_index.coded(rows, fitted), rows, fitted, odd, 5)
    assert {r.query_id for r in found.collect()} == {298, 299}
    exact = vectors.nearest(rows, odd, 5).collect()
    assert {r.query_id for r in exact} == {298, 299, 301, 1001}  # 301 and 1001 find the row of their own size
    assert all(r.distance < 2.1 and r.vec_id not in (300, 302, 303, 304) for r in exact)
    assert vectors.nearest(rows, odd.where("query_id = 300"), 5).collect() == []
    with pytest.raises(ValueError, match="no vectors"):
        vector_index.fit(rows.where("vec_id = 300"))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 5])
def test_near_misses_of_many_names(spark, most):
    rng = random.Random(most)
    word = lambda n: "".join(rng.choice("abA/.") for _ in range(n))
    paths = sorted({word(rng.randrange(0, 14)) for _ in range(150)})
    names = sorted({word(rng.randrange(0, 14)) for _ in range(15)} | {"", paths[3], paths[9][:-1] + "x"})
    docs = spark.createDataFrame([(p,) for p in [*paths, *paths[:5]]], "path string")
    got = lookup.similar_names(docs, spark.createDataFrame([(n,) for n in names], "name string"), most).collect()
    want = []
    for n in names:
        near = sorted((levenshtein(n.lower(), p.lower()), p) for p in paths)
        want += [(n, p, d) for d, p in [x for x in near if x[0] <= most][: lookup.SIMILAR]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_searches_for_many_queries(spark):
    lists = spark.createDataFrame([(q, k, f"c/{(q + k * 3 + r) % 7}.md", f"h{(q + k * 3 + r) % 7}", r, 2.0 if k == 0 else 1.0) for q in range(3) for k in range(2) for r in range(4)], "query_id long, list_idx int, file string, hash string, rank0 int, weight double")
    queries = spark.createDataFrame([(0, "Alpha beta"), (1, "gamma"), (2, "nothing here")], "query_id long, query string")
    content = spark.createDataFrame([(f"h{k}", f"first\nalpha {k}\nalpha beta\ngamma\nbeta alpha") for k in range(7)], "hash string, doc string")
    got = batch.ranked(lists, queries, content, lambda rows: rows.withColumn("rerank_score", F.col("seq") / 10), chunks_of=batch.lines).collect()
    assert {(r.query_id, r.seq, r.text) for r in got} == {(0, 2, "alpha beta"), (1, 3, "gamma"), (2, 0, "first")}
    for q in range(3):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and all(a.score >= b.score for a, b in zip(own, own[1:]))
    plain = batch.ranked(lists, queries, limit=2, least=0.4).collect()
    assert sorted((r.query_id, r["rank"], r.score) for r in plain) == [(q, k, 1 / k) for q in range(3) for k in (1, 2)]
    assert batch.ranked(lists.where("false"), queries).count() == 0
