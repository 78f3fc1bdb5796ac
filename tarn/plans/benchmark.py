"""Retrieval benchmarks: a fixture's queries through four backends, and their metrics."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import evaluation
from tarn.plans import search
from tarn.plans.querydoc import parse_query_document, plain_text

#: Queries whose lists and bodies are made together and held at once.
AT_ONCE = 8
BACKENDS = ("bm25", "vector", "hybrid", "full")
RESULTS = "query_id string, backend string, rank int, file string"


class FixtureError(ValueError):
    pass


@dataclass
class FixtureQuery:
    id: str
    query: str
    expected_files: list[str]
    expected_in_top_k: int


@dataclass
class Fixture:
    queries: list[FixtureQuery]
    collection: str | None = None


def load_fixture(spark: SparkSession, path: str) -> Fixture:
    """A fixture from its JSON file."""
    row = spark.read.json(path, multiLine=True).first()
    if row is None or "queries" not in row:
        raise FixtureError(f"no queries in {path}")
    queries = [FixtureQuery(q["id"], q["query"], list(q["expected_files"]), int(q["expected_in_top_k"])) for q in row["queries"]]
    return Fixture(queries, row["collection"] if "collection" in row else None)


def _files(spark, index, models, q: FixtureQuery, backend: str, scope: list[str] | None) -> list[str]:
    typed, limit = parse_query_document(q.query), max(q.expected_in_top_k, 10)
    if backend in ("bm25", "vector"):
        kinds = ("lex",) if backend == "bm25" else ("vec", "hyde")
        texts = [s.query for s in typed.searches if s.type in kinds] if typed else [plain_text(q.query)]
        if backend == "bm25":
            found = [f"{r['collection']}/{r['path']}" for t in texts for r in search._keyword(index, t, limit, scope)]
        else:
            found = [x.file for t in texts for x in search.by_meaning(index, models, t, limit=limit, collections=scope)]
        return list(dict.fromkeys(found))[:limit]
    options = {"limit": limit, "collections": scope, "rerank": backend == "full"}
    if typed:
        return [x.file for x in search.structured(spark, index, models, list(typed.searches), intent=typed.intent, **options)]
    return [x.file for x in search.hybrid(spark, index, models, plain_text(q.query), **options)]


def _ahead(index: search.Index, models: search.Models, queries: list[FixtureQuery], scope: list[str] | None) -> search.Index:
    """The index with the lists that the backends will ask for, by the same passes for all. Where a provider or a query fails, the backends meet that by themselves."""
    keyword, meant = [], []
    try:
        for q in queries:
            typed = parse_query_document(q.query)
            if typed:
                keyword += [s.query for s in typed.searches if s.type == "lex"]
                asked = [s.query for s in typed.searches if s.type != "lex"]
            else:
                asked = [plain_text(q.query)]
                keyword += [*asked, *(t for kind, t in models.expanded(asked[0]) if kind == "lex")]
            meant += [*asked, *(t for a in asked for kind, t in models.expanded(a) if kind != "lex")]
        most = max(search.LIST, *(q.expected_in_top_k for q in queries))
        return search.ahead(index, models, keyword, meant, most, scope)
    except Exception:  # noqa: BLE001  whatever a provider raises
        return index


def run_fixture(spark: SparkSession, index: search.Index, models: search.Models, fixture: Fixture) -> DataFrame:
    """query_id, backend, the metrics and latency_ms (lists that queries share count for the first to use them). A backend that fails on a query (vectors may be missing) scores zero there."""
    scope = [fixture.collection] if fixture.collection else None
    if scope and not index.docs.where(F.col("collection").isin(scope)).limit(1).count():
        raise FixtureError(f"collection {fixture.collection} has no documents")
    rows, took = [], []
    for at, q in enumerate(fixture.queries):
        start = time.time()
        if at % AT_ONCE == 0:
            ready = _ahead(index, models, fixture.queries[at : at + AT_ONCE], scope)
        for backend in BACKENDS:
            try:
                found = _files(spark, ready, models, q, backend, scope)
            except Exception:  # noqa: BLE001  whatever a provider raises
                found = []
            took.append((q.id, backend, q.expected_in_top_k, (time.time() - start) * 1000))
            start = time.time()
            rows += [(q.id, backend, rank, f) for rank, f in enumerate(found, 1)] or [(q.id, backend, None, None)]
    results = spark.createDataFrame(rows, RESULTS)
    expected = spark.createDataFrame([(q.id, f) for q in fixture.queries for f in q.expected_files], "query_id string, file string")
    times = spark.createDataFrame(took, "query_id string, backend string, k int, latency_ms double")
    out = None
    for k in sorted({q.expected_in_top_k for q in fixture.queries}):
        some = times.where(F.col("k") == k).select("query_id", "backend", "latency_ms")
        m = evaluation.retrieval_metrics(results.join(some.select("query_id").distinct(), "query_id", "left_semi"), expected, k).join(some, ["query_id", "backend"])
        out = m if out is None else out.unionByName(m)
    return out
