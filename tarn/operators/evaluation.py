"""Retrieval metrics and the matching of query expansions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.paths import same_file

#: Words that don't count in matching expansions (fixed values).
STOP_WORDS = "the a an is are to for of in and or it this that be with as on by how what do does can you your i".split()
#: Similarity from which an expansion of a type counts as matched (fixed values).
THRESHOLDS = {"lex": 0.5, "vec": 0.35, "hyde": 0.25}


def retrieval_metrics(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Metrics of each query and backend.

    ``results``: query_id, backend, rank (from 1), file. ``expected``: query_id, file; each query expects a few files, and the two are joined
    by query. Precision divides by the lesser of k and the expected; a file matches by its path's end.
    """
    runs = results.select("query_id", "backend").distinct()
    want = expected.select("query_id", F.col("file").alias("expected")).distinct()
    pairs = want.join(runs, "query_id").join(results, ["query_id", "backend"], "left")
    hit = F.when(same_file(F.col("file"), F.col("expected")), F.col("rank"))
    first = pairs.groupBy("query_id", "backend", "expected").agg(F.min(hit).alias("first"))
    total, within = F.count(F.lit(1)), lambda n: F.count_if(F.col("first") <= n)
    m = first.groupBy("query_id", "backend").agg(
        total.alias("total_expected"), within(k).alias("hits_at_k"), F.count("first").alias("found"), F.min("first").alias("best"),
        *((within(n) / total).alias(f"recall_at_{n}") for n in (1, 3, 5)),
    )
    precision, recall = F.col("hits_at_k") / F.least(F.lit(k), F.col("total_expected")), F.col("found") / F.col("total_expected")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return m.select(
        "query_id", "backend", "total_expected", "hits_at_k", precision.alias("precision_at_k"), recall.alias("recall"),
        "recall_at_1", "recall_at_3", "recall_at_5", F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr"), f1.alias("f1"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Means by backend, and whether all of a backend's are zero."""
    names = ("precision_at_k", "recall", "recall_at_1", "recall_at_3", "recall_at_5", "mrr", "f1")
    out = metrics.groupBy("backend").agg(*(F.avg(n).alias(n) for n in names), F.count(F.lit(1)).alias("n_queries"))
    return out.withColumn("all_zero", sum((F.col(n) for n in names), F.lit(0.0)) == 0)


def hit_rate(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """difficulty, n, hit_rate: the share of queries with an expected document's name in a path of the first k. ``expected``: query_id, expected_doc, difficulty."""
    seen = F.when((F.col("rank") <= k) & F.lower("file").contains(F.lower(F.col("expected_doc"))), 1).otherwise(0)
    each = expected.join(results, "query_id", "left").groupBy("query_id", "difficulty").agg(F.max(F.coalesce(seen, F.lit(0))).alias("hit"))
    return each.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("hit_rate"))


def word_set(text: Column) -> Column:
    """Distinct words of more than one character without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of word sets; 0 where either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def expansion_matches(predicted: DataFrame, golden: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """query_id, type, pred_no, golden_no (null: none), similarity: the best golden expansion of each prediction, the first of equals.

    Both: query_id, type, no, text; a query has a few of each type.
    """
    p = predicted.select("query_id", "type", F.col("no").alias("pred_no"), word_set(F.col("text")).alias("p"))
    g = golden.select("query_id", "type", F.col("no").alias("golden_no"), word_set(F.col("text")).alias("g"))
    both = p.join(g, ["query_id", "type"], "left").withColumn("s", F.when(F.col("g").isNull(), 0.0).otherwise(jaccard(F.col("p"), F.col("g"))))
    best = both.groupBy("query_id", "type", "pred_no").agg(F.max(F.struct("s", (-F.col("golden_no")).alias("m"))).alias("b"))
    limit = F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv))[F.col("type")]
    ok = (F.col("b.s") > 0) & (F.col("b.s") >= limit)
    return best.select("query_id", "type", "pred_no", F.when(ok, -F.col("b.m")).alias("golden_no"), F.col("b.s").alias("similarity"))


def expansion_metrics(predicted: DataFrame, golden: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """type (and overall), pred_count, golden_count, matched, precision, recall, f1 over all queries.

    A type's recall counts golden expansions that are matched, the overall one the matched predictions.
    """
    m = expansion_matches(predicted, golden, thresholds)
    by_type = m.groupBy("type").agg(F.count(F.lit(1)).alias("pred_count"), F.count("golden_no").alias("matched"), F.count_distinct("query_id", "golden_no").alias("golden_matched"))
    n = golden.groupBy("type").agg(F.count(F.lit(1)).alias("golden_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = by_type.join(n, "type", "full_outer").select("type", zero("pred_count"), zero("golden_count"), zero("matched"), zero("golden_matched"))
    overall = rows.agg(F.lit("overall").alias("type"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pred_count", "golden_count", "matched")), F.coalesce(F.sum("matched"), F.lit(0)).alias("golden_matched"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = rows.unionByName(overall).withColumn("precision", ratio("matched", "pred_count")).withColumn("recall", ratio("golden_matched", "golden_count"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.select("type", "pred_count", "golden_count", "matched", "precision", "recall", f1.alias("f1"))


def distinct_queries(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first example of each query, whatever its case and outer blanks."""
    from tarn.operators.lookup import first_of_each

    return first_of_each(rows.withColumn("_q", F.lower(F.trim("query"))), ["_q"], order).drop("_q")


def train_eval_split(rows: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """With ``split`` (train or eval) by a hash of the query, which any order and partitioning leave as it is."""
    at = F.pmod(F.xxhash64("query", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    return rows.withColumn("split", F.when(at < share, "eval").otherwise("train"))
