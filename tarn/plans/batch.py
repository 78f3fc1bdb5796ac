"""Hybrid searches for a table of queries: one plan from ranked lists to blended ranks.

Everything is keyed by query_id, and nothing of a request passes through the driver:
lists are fused by aggregation, candidates fetch their bodies by a semi-join, chunks
compete by expressions, and a window ranks what the blend gives.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import intent_terms
from tarn.operators import bm25, fusion, vectors
from tarn.operators.chunking import chunk_rows
from tarn.plans import lexquery
from tarn.plans.search import LIMIT, LIST

_COLUMNS = ["query_id", "list_idx", "source", "query_type", "query", "file", "hash", "rank0", "backend_score", "weight"]


def _listed(rows: DataFrame, list_idx: int, source: str, kind: str, query: Column, weight: float, order: list) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    ranked = rows.withColumn("rank0", F.row_number().over(w) - 1)
    return ranked.select("query_id", F.lit(list_idx).alias("list_idx"), F.lit(source).alias("source"), F.lit(kind).alias("query_type"), query.alias("query"), F.concat_ws("/", "collection", "path").alias("file"), "hash", "rank0", F.col("score").alias("backend_score"), F.lit(weight).alias("weight"))


def keyword_lists(index: bm25.Scan | bm25.Postings, docs: DataFrame, asked: list[tuple[int, str]], analyzer: str = "simple", list_idx: int = 0, kind: str = "original", weight: float = 2.0, limit: int = LIST) -> DataFrame | None:
    """The keyword list of each of a stated set of queries (query_id, text); queries that name nothing positive have none."""
    found = []
    for query_id, text in asked:
        plan = lexquery.parse(text, analyzer)
        if plan:
            rows = bm25.search(index, docs, plan, limit).withColumn("query_id", F.lit(query_id).cast("long"))
            found.append(_listed(rows, list_idx, "fts", kind, F.lit(text), weight, [F.desc(F.round("score", 12)), "doc_id"]))
    return reduce(DataFrame.unionByName, found) if found else None


def vector_lists(chunks: DataFrame, docs: DataFrame, asked: DataFrame, list_idx: int = 1, kind: str = "original", weight: float = 2.0, limit: int = LIST) -> DataFrame:
    """The list of each of ``asked`` (query_id, embedding), by the best chunk (``chunks``: hash, seq, embedding) of a document: one pass over the vectors for all of them."""
    # a body may own many of the nearest chunks, and a document is one of several with a body: both are cut after the join
    near = vectors.nearest_bodies(chunks, asked, limit)
    rows = near.join(docs.select("doc_id", "collection", "path", "hash"), "hash").withColumn("score", 1 - F.col("distance"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "doc_id")
    rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    return _listed(rows, list_idx, "vec", kind, F.lit(""), weight, [F.desc(F.round("score", 12)), "doc_id"])


def lines(bodies: DataFrame) -> DataFrame:
    """hash, seq, pos, text: a body's lines as its chunks."""
    cut = bodies.select("hash", F.posexplode(F.split("doc", "\n")).alias("seq", "text"))
    return cut.select("hash", "seq", F.lit(0).alias("pos"), "text")


def best_chunks(candidates: DataFrame, queries: DataFrame, content: DataFrame, chunks_of: Callable[[DataFrame], DataFrame] = chunk_rows, intent: str | None = None) -> DataFrame:
    """query_id, hash, seq, pos, text: of each candidate's body (query_id, hash) the chunk with most of the query's words (queries: query_id, query), the first of equals. Only candidates' bodies are read and cut, each once."""
    wanted = candidates.select("query_id", "hash").distinct()
    cut = chunks_of(content.join(wanted.select("hash").distinct(), "hash", "left_semi").select("hash", "doc"))
    words = queries.select("query_id", F.filter(F.split(F.lower("query"), r"\s+"), lambda t: F.char_length(t) > 2).alias("words"))
    low, meant = F.lower("text"), intent_terms(intent)
    held = F.aggregate("words", F.lit(0.0), lambda s, t: s + low.contains(t).cast("double"))
    held = held + sum((low.contains(t).cast("double") * fusion.INTENT_WEIGHT for t in meant), F.lit(0.0))
    rows = wanted.join(words, "query_id").join(cut.select("hash", "seq", "pos", "text"), "hash")
    best = rows.groupBy("query_id", "hash").agg(F.min_by(F.struct("seq", "pos", "text"), F.struct((-held).alias("h"), "seq")).alias("b"))
    return best.select("query_id", "hash", "b.*")


def ranked(lists: DataFrame, queries: DataFrame, content: DataFrame | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, *, limit: int = LIMIT, least: float = 0.0, candidates: int = fusion.CANDIDATES, chunks_of: Callable[[DataFrame], DataFrame] = chunk_rows, intent: str | None = None) -> DataFrame:
    """query_id, rank, file, hash, score, fused_rank (and seq, pos, text of the best chunk, if ``content`` is given).

    ``lists``: ranked lists of any number of queries (query_id, list_idx, file, hash, rank0, weight). ``rerank`` adds a column rerank_score to the
    candidates (query_id, file, hash, query, and text); without it a fused rank's inverse is the score.
    """
    fused = fusion.fused_rank(fusion.fuse(lists)).where(F.col("fused_rank") <= candidates).select("query_id", "file", "fused_rank")
    hashes = lists.groupBy("query_id", "file").agg(F.min("hash").alias("hash"))
    rows = fused.join(hashes, ["query_id", "file"]).join(queries.select("query_id", "query"), "query_id")
    told = []
    if content is not None:
        rows = rows.join(best_chunks(rows, queries, content, chunks_of, intent), ["query_id", "hash"], "left")
        told = ["seq", "pos", "text"]
    rank = F.col("fused_rank")
    score = fusion.blended(rank, F.col("rerank_score")) if rerank else 1 / rank
    rows = (rerank(rows) if rerank else rows).withColumn("score", score).where(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "fused_rank")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "file", "hash", "score", "fused_rank", *told)
