"""How often a fixture's queries read the texts, and that lists made together are those made one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tarn import providers
from tarn.operators import bm25, vectors
from tarn.plans import benchmark, search
from tarn.plans.benchmark import Fixture, FixtureQuery
from tarn.plans.lexquery import parse

QUERIES = ["w1 w2", "lex: w3 -w4\nvec: w5 w6", '"w0 w1"', "w7", "lex: w2\nlex: w3\nhyde: all of w2"]


def documents(spark, n=60):
    rng = random.Random(2)
    rows = [(k, f"c{k % 2}", f"{k}.md", f"t{k % 5}", f"h{k // 2}", " ".join(f"w{min(9, int(rng.expovariate(0.3)))}" for _ in range(30))) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, collection string, path string, title string, hash string, body string")


def index_of(docs, seen):
    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    read = docs.mapInArrow(counted, docs.schema)
    v = docs.select("hash", F.lit(0).alias("seq"), F.lit(0).alias("pos"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda x: F.sin(x * F.col("doc_id")).cast("float")).alias("embedding")).dropDuplicates(["hash"])
    return search.Index(docs.drop("body"), read.groupBy("hash").agg(F.first("body").alias("doc")), bm25.Scan(read), v)


def models():
    return search.Models(providers.HashEmbedder(16), providers.PlainExpander(), providers.OverlapReranker())


def test_a_fixture_reads_the_texts_a_few_times_and_finds_the_same(spark, monkeypatch):
    docs, seen = documents(spark), spark.sparkContext.accumulator(0)
    fixture = Fixture([FixtureQuery(f"q{k}", q, ["3.md", "8.md"], 5) for k, q in enumerate(QUERIES)])
    asked, files = [], benchmark._files
    monkeypatch.setattr(benchmark, "_files", lambda spark_, index, m, q, backend, scope: asked.append((q.id, backend, files(spark_, index, m, q, backend, scope))) or asked[-1][2])
    got = benchmark.run_fixture(spark, index_of(docs, seen), models(), fixture)
    assert 0 < seen.value <= 4 * docs.count()  # statistics, scores and bodies, whatever the number of queries
    assert got.count() == 4 * len(QUERIES) and all(f for _, _, f in asked)
    for k, q in enumerate(fixture.queries[:3]):
        for backend in benchmark.BACKENDS:
            own = files(spark, index_of(docs, seen), models(), q, backend, None)
            assert (q.id, backend, own) in asked


@pytest.mark.parametrize("scope", [None, ["c1"]])
def test_lists_of_several_queries(spark, scope):
    docs = documents(spark)
    plans = [parse(q) for q in ("w1 w2", '"w0 w1" -w9', "w3 -w4", "w", "nothing")]
    rows = bm25.search_all(bm25.Scan(docs), docs, plans, 7, scope).collect()
    for k, p in enumerate(plans):
        want = bm25.search(bm25.Scan(docs), docs, p, 7, scope).collect()
        assert [tuple(r)[1:] for r in rows if r["plan"] == k] == [tuple(r) for r in want], k
    index, asked = index_of(docs, spark.sparkContext.accumulator(0)), [[1.0] * 16, [0.0] * 15 + [1.0], [0.0] * 16, [1.0] * 3]
    rows = vectors.search_vectors_all(index.vectors, docs, asked, 7, scope).collect()
    for k, q in enumerate(asked):
        want = vectors.search_vectors(index.vectors, docs, q, 7, scope).collect()
        assert [tuple(r)[1:] for r in rows if r["query"] == k] == [tuple(r) for r in want], k


def test_a_provider_that_fails_on_one_query(spark):
    class Odd(providers.HashEmbedder):
        def embed(self, texts):
            if any("w7" in t for t in texts):
                raise RuntimeError("no")
            return super().embed(texts)

    m = search.Models(Odd(16), providers.PlainExpander(), providers.OverlapReranker())
    fixture = Fixture([FixtureQuery("ok", "w1", [f"{k}.md" for k in range(60)], 5), FixtureQuery("fails", "w7", [f"{k}.md" for k in range(60)], 5)])
    got = {(r.query_id, r.backend): r.mrr for r in benchmark.run_fixture(spark, index_of(documents(spark), spark.sparkContext.accumulator(0)), m, fixture).collect()}
    assert got["ok", "vector"] == got["ok", "full"] == got["fails", "bm25"] == 1 and got["fails", "vector"] == got["fails", "full"] == 0
