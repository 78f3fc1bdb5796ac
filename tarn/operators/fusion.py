"""Reciprocal-rank fusion, its trace, best chunks and the blend with a reranker's scores.

Ranked lists are one long frame: query_id, list_idx, file, rank0 (from 0), weight
and whatever else describes a list; a batch of queries is fused in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fusion's constant and bonuses, candidates kept, and the blend's weights by rank (fixed values).
K = 60
BONUS = ((0, 0.05), (2, 0.02))
CANDIDATES = 40
BLEND = ((3, 0.75), (10, 0.60))
BLEND_REST = 0.40
#: Top score and gap to the second at which a keyword search needs no expansion (fixed values).
STRONG_SCORE, STRONG_GAP = 0.85, 0.15
#: What an intent's word counts in choosing a chunk (fixed value).
INTENT_WEIGHT = 0.5


def bonus(best_rank0: Column) -> Column:
    out = F.lit(0.0)
    for rank, more in reversed(BONUS):
        out = F.when(best_rank0 <= rank, F.lit(more)).otherwise(out)
    return out


def hybrid_weight(query_type: Column) -> Column:
    """The user's own words count twice what expansions count."""
    return F.when(query_type == "original", F.lit(2.0)).otherwise(F.lit(1.0))


def structured_weight(list_idx: Column) -> Column:
    """The first list that isn't empty counts twice."""
    return F.when(list_idx == 0, F.lit(2.0)).otherwise(F.lit(1.0))


def fuse(lists: DataFrame, k: int = K) -> DataFrame:
    """query_id, file, base, best_rank0, bonus, score, first_list, first_rank: one row a file."""
    place = F.struct("list_idx", "rank0")
    out = lists.groupBy("query_id", "file").agg(F.sum(F.col("weight") / (k + F.col("rank0") + 1)).alias("base"), F.min("rank0").alias("best_rank0"), F.min(place).alias("place"))
    out = out.withColumn("bonus", bonus(F.col("best_rank0")))
    return out.select("query_id", "file", "base", "best_rank0", "bonus", (F.col("base") + F.col("bonus")).alias("score"), F.col("place.list_idx").alias("first_list"), F.col("place.rank0").alias("first_rank"))


def fused_rank(fused: DataFrame) -> DataFrame:
    """With ``fused_rank`` from 1: by score, ties in the order in which files were first seen."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first_list", "first_rank")
    return fused.withColumn("fused_rank", F.row_number().over(w))


def trace(lists: DataFrame, k: int = K) -> DataFrame:
    """query_id, file, contributions (in list order), base, best_rank (from 1), bonus, total."""
    one = F.struct("list_idx", "source", "query_type", "query", (F.col("rank0") + 1).alias("rank"), "weight", "backend_score", (F.col("weight") / (k + F.col("rank0") + 1)).alias("contribution"))
    found = lists.groupBy("query_id", "file").agg(F.array_sort(F.collect_list(one)).alias("contributions"), F.min("rank0").alias("r"))
    base = F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["contribution"])
    return found.select("query_id", "file", "contributions", base.alias("base"), (F.col("r") + 1).alias("best_rank"), bonus(F.col("r")).alias("bonus"), (base + bonus(F.col("r"))).alias("total"))


def best_chunk(chunks: Column, query_terms: list[str], intent_words: list[str] = ()) -> Column:
    """Number of the chunk (array of structs with ``text``) that holds most of the words, the first of equals. A word given twice counts twice."""
    def held(x):
        low = F.lower(x["text"])
        score = sum((low.contains(t).cast("double") for t in query_terms), F.lit(0.0))
        return score + sum((low.contains(t).cast("double") * INTENT_WEIGHT for t in intent_words), F.lit(0.0))

    return F.array_min(F.transform(chunks, lambda x, i: F.struct((-held(x)).alias("s"), i.alias("i"))))["i"]


def chunk_terms(query: str) -> list[str]:
    """Words of a query that count in choosing a chunk."""
    return [t for t in query.lower().split() if len(t) > 2]


def blend_weight(rank: Column) -> Column:
    """How much a fused rank counts beside the reranker: much at the top, less below."""
    out = F.lit(BLEND_REST)
    for most, weight in reversed(BLEND):
        out = F.when(rank <= most, F.lit(weight)).otherwise(out)
    return out


def blended(rank: Column, rerank_score: Column) -> Column:
    w = blend_weight(rank)
    return w * (1 / rank) + (1 - w) * rerank_score


def strong_signal(top: DataFrame) -> DataFrame:
    """query_id, top, second, strong, from rows (query_id, score): whether the first result is good and well ahead."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"))
    two = top.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("query_id").agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    second = F.when(F.col("n") > 1, F.col("low")).otherwise(F.lit(0.0))
    return two.select("query_id", "top", second.alias("second"), ((F.col("top") >= STRONG_SCORE) & (F.col("top") - second >= STRONG_GAP)).alias("strong"))
