"""Connected components of an edge table, distributed: the smallest label spreads along edges, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): for every node of the edges (a, b) the smallest node that it reaches.

    Each round takes the least label among neighbours and then the label's own
    label, and is written to a table; stars end after two rounds, and a path of n
    nodes in about log n.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = scratch.table(both, f"{name}-edges")
    now = scratch.table(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), f"{name}-0")
    k = 0
    while True:
        near = both.join(now.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        best = now.join(near, "node").select("node", F.least("label", "near").alias("best"), "label")
        jump = best.select(F.col("node").alias("best"), F.col("best").alias("further"))
        new = best.join(jump, "best").select("node", F.least("best", "further").alias("label"), (F.least("best", "further") != F.col("label")).alias("changed"))
        new = scratch.table(new, f"{name}-{k + 1}")
        changed = bool(new.where("changed").limit(1).count())
        scratch.drop(f"{name}-{k}")
        k += 1
        now = new.select("node", "label")
        if not changed:
            scratch.drop(f"{name}-edges")
            return now
