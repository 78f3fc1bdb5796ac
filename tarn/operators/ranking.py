"""Ranks, best-of-file and top-k in groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order():
    return [F.desc(F.round("score", 12)), F.asc("doc_id")]


def ranked(df: DataFrame, groups: list[str], name: str = "rank", first: int = 0) -> DataFrame:
    """Position in each group by score, ties by doc_id."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*_order())) - 1 + first)


def top_of_each(df: DataFrame, groups: list[str], k: int) -> DataFrame:
    """The best k rows of each group. Spark keeps k rows of a group in each task before the shuffle."""
    return ranked(df, groups, "_rank").where(F.col("_rank") < k).drop("_rank")


def best_of_file(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each file's row with the greatest score, ties to the smaller doc_id; an aggregate, not a window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.round("score", 12).alias("s"), (-F.col("doc_id")).alias("d")))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*").select(*df.columns)
