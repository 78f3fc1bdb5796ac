"""Searches of one request: hybrid, structured and by meaning alone.

Steps before fusion run over the whole index and end in a top-k; from there on a
request has some dozens of rows, which the driver holds for the providers.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import intent_terms
from tarn.operators import bm25, fusion, vectors
from tarn.operators.chunking import chunk
from tarn.plans import lexquery
from tarn.plans.querydoc import TypedQuery
from tarn.providers import Embedder, Expander, Reranker, query_prompt

#: Results of a backend's list, of a search, and the least score of a search by meaning (fixed values).
LIST, LIMIT, LEAST_BY_MEANING = 20, 10, 0.3

LISTS = "query_id long, list_idx int, source string, query_type string, query string, file string, rank0 int, backend_score double, weight double"


@dataclass
class Index:
    """What is searched: documents (doc_id, collection, path, title, hash), their bodies, terms and vectors."""

    docs: DataFrame
    content: DataFrame
    terms: bm25.Scan | bm25.Postings
    vectors: DataFrame | None = None
    analyzer: str = "simple"
    #: Lists that were made ahead for a set of requests, by kind, query and collections, and the bodies of what is in them.
    ahead: dict[tuple, list[Row]] = field(default_factory=dict)
    bodies: dict[str, str] = field(default_factory=dict)


@dataclass
class Models:
    embedder: Embedder
    expander: Expander
    reranker: Reranker
    cache: dict[str, object] = field(default_factory=dict)

    def expanded(self, query: str) -> list[tuple[str, str]]:
        """Typed expansions, none that echoes the query; kept by query and model."""
        from tarn.providers import cache_key

        key = cache_key("expand", self.expander.name, query)
        if key not in self.cache:
            self.cache[key] = [(t, q) for t, q in self.expander.expand(query) if q.strip().lower() != query.strip().lower()]
        return self.cache[key]

    def forget(self, query: str) -> None:
        """Drop an expansion that led to nothing, so that it is made again."""
        from tarn.providers import cache_key

        self.cache.pop(cache_key("expand", self.expander.name, query), None)

    def reranked(self, query: str, texts: list[str], intent: str | None = None) -> list[float]:
        """Scores of texts; equal texts are scored once, and what was scored before isn't again."""
        from tarn.providers import cache_key

        asked = f"{intent}\n\n{query}" if intent else query
        keys = {t: cache_key("rerank", self.reranker.name, asked, t) for t in texts}
        todo = [t for t in dict.fromkeys(texts) if keys[t] not in self.cache]
        if todo:
            self.cache.update(zip((keys[t] for t in todo), self.reranker.rerank(asked, todo)))
        return [self.cache[keys[t]] for t in texts]


@dataclass
class Found:
    """A result: file is collection/path."""

    file: str
    title: str
    score: float
    docid: str
    best_chunk: str = ""
    best_chunk_pos: int = 0
    body: str = ""
    explain: dict | None = None


def _key(kind: str, query: str, collections: list[str] | None) -> tuple:
    return kind, query, tuple(collections or ())


def _keywords(index: Index, queries: list[str], limit: int, collections: list[str] | None) -> list[list[Row]]:
    """A list for each query: with texts that were never indexed all of them in the same two passes."""
    plans = {q: lexquery.parse(q, index.analyzer) for q in dict.fromkeys(queries) if _key("fts", q, collections) not in index.ahead}
    several = {q: p for q, p in plans.items() if p}
    if len(several) < 2 or not isinstance(index.terms, bm25.Scan) or (collections and len(collections) > 1):
        return [_keyword(index, q, limit, collections) for q in queries]
    found: dict[str, list[Row]] = {q: [] for q in plans}
    for r in bm25.search_all(index.terms, index.docs, list(several.values()), limit, collections).collect():
        found[list(several)[r["plan"]]].append(r)
    return [found[q] if q in found else _keyword(index, q, limit, collections) for q in queries]


def _keyword(index: Index, query: str, limit: int, collections: list[str] | None) -> list[Row]:
    if _key("fts", query, collections) in index.ahead:
        return index.ahead[_key("fts", query, collections)][:limit]
    plan = lexquery.parse(query, index.analyzer)
    if collections and len(collections) > 1:
        return bm25.search_each(index.terms, index.docs, plan, limit, collections).collect()
    return bm25.search(index.terms, index.docs, plan, limit, collections).collect()


def _meaning(index: Index, models: Models, queries: list[str], limit: int, collections: list[str] | None) -> list[list[Row]]:
    """A list for each query; all are embedded in one call, and looked for in one pass over the vectors."""
    if index.vectors is None or not queries:
        return [[] for _ in queries]
    found = {q: index.ahead[_key("vec", q, collections)][:limit] for q in queries if _key("vec", q, collections) in index.ahead}
    todo = [q for q in dict.fromkeys(queries) if q not in found]
    embedded = zip(todo, models.embedder.embed([query_prompt(q, models.embedder.name) for q in todo]) if todo else [])
    asked = {q: v for q, v in embedded if v is not None}
    found |= {q: [] for q in todo}
    if collections and len(collections) > 1:
        found |= {q: vectors.search_vectors_each(index.vectors, index.docs, v, limit, collections).collect() for q, v in asked.items()}
    elif asked:
        for r in vectors.search_vectors_all(index.vectors, index.docs, list(asked.values()), limit, collections).collect():
            found[list(asked)[r["query"]]].append(r)
    return [found[q] for q in queries]


def ahead(index: Index, models: Models, keyword: list[str], meant: list[str], limit: int, collections: list[str] | None = None) -> Index:
    """The index with the lists of these queries by keywords and by meaning, and the bodies of the first LIST of each: what requests find there they don't look for. For a bounded set of requests, in at most one collection."""
    keyword, meant = list(dict.fromkeys(keyword)), list(dict.fromkeys(meant))
    lists = {_key("fts", q, collections): rows for q, rows in zip(keyword, _keywords(index, keyword, limit, collections))}
    lists |= {_key("vec", q, collections): rows for q, rows in zip(meant, _meaning(index, models, meant, limit, collections))}
    return replace(index, ahead=index.ahead | lists, bodies=index.bodies | _bodies(index, {r["hash"] for rows in lists.values() for r in rows[:LIST]}))


def _bodies(index: Index, hashes: set[str]) -> dict[str, str]:
    todo = [h for h in hashes if h not in index.bodies]
    read = {r["hash"]: r["doc"] for r in index.content.where(F.col("hash").isin(todo)).select("hash", "doc").collect()} if todo else {}
    return {h: index.bodies[h] for h in hashes if h in index.bodies} | read


def _file(r: Row) -> str:
    return f"{r['collection']}/{r['path']}"


def hybrid(spark: SparkSession, index: Index, models: Models, query: str, *, limit: int = LIMIT, least: float = 0.0, candidates: int = fusion.CANDIDATES, collections: list[str] | None = None, intent: str | None = None, rerank: bool = True, explain: bool = False) -> list[Found]:
    """The query's own keyword list, lists of its expansions by type, fused, reranked by best chunk, blended.

    A first keyword result that is good and well ahead makes expansion needless, unless an intent says that the words alone don't tell.
    """
    first = _keyword(index, query, LIST, collections)
    scores = [r["score"] for r in first] + [0.0, 0.0]
    strong = not intent and bool(first) and scores[0] >= fusion.STRONG_SCORE and scores[0] - scores[1] >= fusion.STRONG_GAP
    more = [] if strong else models.expanded(query)
    lists = [("fts", "original", query, first)] if first else []
    words = [q for t, q in more if t == "lex"]
    lists += [("fts", "lex", q, rows) for q, rows in zip(words, _keywords(index, words, LIST, collections)) if rows]
    meant = [("original", query), *((t, q) for t, q in more if t in ("vec", "hyde"))]
    lists += [("vec", t, q, rows) for (t, q), rows in zip(meant, _meaning(index, models, [q for _, q in meant], LIST, collections)) if rows]
    if more and not any(x[1] != "original" for x in lists):
        models.forget(query)
    weighted = [(*x, 2.0 if x[1] == "original" else 1.0) for x in lists]
    return _finish(spark, index, models, query, query, weighted, limit, least, candidates, intent, rerank, explain)


def structured(spark: SparkSession, index: Index, models: Models, queries: list[TypedQuery], *, limit: int = LIMIT, least: float = 0.0, candidates: int = fusion.CANDIDATES, collections: list[str] | None = None, intent: str | None = None, rerank: bool = True, explain: bool = False) -> list[Found]:
    """Typed queries as given: one list a query and collection, keyword lists before the others; the first that isn't empty counts twice."""
    for q in queries:
        if q.type == "lex":
            lexquery.validate_lex(q.query)
        else:
            lexquery.validate_semantic(q.query)
    scopes = [[c] for c in collections] if collections else [None]
    words = [q.query for q in queries if q.type == "lex"]
    held = [_keywords(index, words, LIST, s) for s in scopes]
    lists = [("fts", "lex", q, got[k]) for k, q in enumerate(words) for got in held if got[k]]
    meant = [q for q in queries if q.type != "lex"]
    by_scope = [_meaning(index, models, [q.query for q in meant], LIST, s) for s in scopes]
    lists += [("vec", q.type, q.query, got[k]) for k, q in enumerate(meant) for got in by_scope if got[k]]
    weighted = [(*x, 2.0 if k == 0 else 1.0) for k, x in enumerate(lists)]
    by_type = {t: next((q.query for q in queries if q.type == t), None) for t in ("lex", "vec")}
    primary = by_type["lex"] or by_type["vec"] or (queries[0].query if queries else "")
    return _finish(spark, index, models, primary, primary, weighted, limit, least, candidates, intent, rerank, explain)


def by_meaning(index: Index, models: Models, query: str, *, limit: int = LIMIT, least: float = LEAST_BY_MEANING, collections: list[str] | None = None) -> list[Found]:
    """The query and its vec and hyde expansions, each searched; the best score of a file."""
    texts = [query, *(q for t, q in models.expanded(query) if t in ("vec", "hyde"))]
    best: dict[str, Row] = {}
    for rows in _meaning(index, models, texts, limit, collections):
        for r in rows:
            if _file(r) not in best or r["score"] > best[_file(r)]["score"]:
                best[_file(r)] = r
    some = sorted((r for r in best.values() if r["score"] >= least), key=lambda r: (-r["score"], _file(r)))
    return [Found(_file(r), r["title"], r["score"], r["hash"][:6], best_chunk_pos=r["pos"]) for r in some[:limit]]


def ranked_lists(spark: SparkSession, lists: list[tuple], query_id: int = 0) -> DataFrame:
    """Lists (source, type, query, rows, weight) as the long frame that fusion takes."""
    rows = [(query_id, k, source, kind, q, _file(r), rank, float(r["score"]), weight) for k, (source, kind, q, found, weight) in enumerate(lists) for rank, r in enumerate(found)]
    return spark.createDataFrame(rows, LISTS)


def _finish(spark, index, models, query, rerank_query, lists, limit, least, candidates, intent, rerank, explain) -> list[Found]:
    if not lists:
        return []
    frame = ranked_lists(spark, lists)
    fused = fusion.fused_rank(fusion.fuse(frame)).where(F.col("fused_rank") <= candidates).orderBy("fused_rank").collect()
    known = {_file(r): r for _, _, _, rows, _ in lists for r in rows}
    bodies = _bodies(index, {known[f["file"]]["hash"] for f in fused})  # ``candidates`` at most
    words, meant = fusion.chunk_terms(query), intent_terms(intent)
    out = []
    for f in fused:
        r = known[f["file"]]
        body = bodies.get(r["hash"], "")
        parts = chunk(body, path=r["path"])
        held = [sum(t in x.lower() for t in words) + fusion.INTENT_WEIGHT * sum(t in x.lower() for t in meant) for _, x in parts]
        pos, text = parts[held.index(max(held))]
        out.append(Found(f["file"], r["title"], 0.0, r["hash"][:6], text, pos, body))
    scores = models.reranked(rerank_query, [x.best_chunk for x in out], intent) if rerank else []
    traces = {t["file"]: t.asDict(recursive=True) for t in fusion.trace(frame).collect()} if explain else {}
    for k, x in enumerate(out, 1):
        w = next((w for most, w in fusion.BLEND if k <= most), fusion.BLEND_REST)
        x.score = w / k + (1 - w) * scores[k - 1] if rerank else 1 / k
        if explain:
            x.explain = {"rank": k, "rerank_score": scores[k - 1] if rerank else None, "fusion": traces[x.file]}
    seen: set[str] = set()
    some = [x for x in sorted(out, key=lambda x: -x.score) if x.score >= least and not (x.file in seen or seen.add(x.file))]
    return some[:limit]
