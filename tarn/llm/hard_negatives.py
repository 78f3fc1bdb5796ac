"""Hard negatives by k-means inverted lists, searched in the order of an upper bound.

Rows are listed under their nearest centroid, and a list keeps its radius, the
largest distance of a row from the centroid. By Cauchy and Schwarz the inner product
of an anchor a with a row of a list lies within a.c - |a| r and a.c + |a| r. An anchor
visits lists by descending upper bound, some at a time: the first ones, then ever
more, while the upper bound of the next isn't below the kth score that it has. Lists
that can hold no score of its window (the bounds lie outside it) are skipped. So the
result is exact; how many rows are looked at depends on how the vectors cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import Scratch, ship

#: Centroids are fitted on so many rows at most (chosen by hash), in so many rounds. They steer cost only.
SAMPLE, FIT_ROUNDS = 16_384, 8
#: Rows of a list, on the average; lists at most; rows of a block of a list; anchors that are held against a block at once.
LIST_ROWS, LISTS, BLOCK_ROWS, ANCHOR_ROWS = 1000, 1024, 2048, 32_768
#: Lists that an anchor visits in the first round; each next round visits so many times more.
FIRST, GROWTH = 4, 4
#: Inner products below this are exact in doubles.
EXACT = 2.0**53


def prepared(vectors: DataFrame, modulus: int, classes: int, scale: float) -> DataFrame:
    """vec_id, label, v (floor(scale x) as doubles) of the rows that take part, wrongly labelled where the modulus divides vec_id.

    Vectors of another length than the most frequent one (ties: the shorter) have no inner product with the others and take no part.
    """
    rows = vectors.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`label`").cast("long").alias("label"), F.col("`embedding`").alias("x"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", number))
    usual = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("x") == (usual["n"] if usual else 0))
    label = F.when(F.col("vec_id") % modulus == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    # a floor that is no long (a component of 2**55 or more) stays a double
    floors = F.transform("x", lambda x: F.when(F.abs(x.cast("double")) < 2.0**54, F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale))
    return rows.select("vec_id", label.alias("label"), floors.alias("v"))


def _matrix(raw: list, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exactly: in doubles where these hold them, else in Python's integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= EXACT:
        whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
        return (whole(a) @ whole(b).T).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def fit(sample: np.ndarray, k: int) -> np.ndarray:
    """Centroids of a sample by Lloyd's rounds from evenly spaced rows of it; unused ones stay."""
    c = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)].copy()
    for _ in range(FIT_ROUNDS):
        own = nearest(sample, c)
        total, count = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(total, own, sample)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.argmin(np.nan_to_num((c * c).sum(1)[None, :] - 2 * (v @ c.T), nan=np.inf), axis=1)


class Lists:
    """Inverted lists of prepared rows in a scratch folder: blocks of (list, chunk), and a small directory on the driver."""

    def __init__(self, rows: DataFrame, scratch: Scratch):
        self.spark, self.scratch = rows.sparkSession, scratch
        n = rows.count()
        drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
        self.centroids = fit(np.array([r["v"] for r in drawn], np.float64), max(1, min(LISTS, -(-n // LIST_ROWS))))
        self.dims = self.centroids.shape[1]
        centroids = self.centroids

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    own = nearest(v, centroids)
                    far = np.sqrt(((v - centroids[own]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in v], pa.binary()), pa.array(own, pa.int32()), pa.array(far)], names=["vec_id", "label", "v", "list", "far"])

        self.rows = scratch.table(rows.mapInArrow(assign, "vec_id long, label long, v binary, list int, far double"), "rows")
        held = {r["list"]: (r["n"], r["far"]) for r in self.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # LISTS rows at most
        self.radius = np.array([held.get(k, (0, -np.inf))[1] for k in range(len(centroids))])
        self.chunks = np.array([-(-held.get(k, (0, 0))[0] // BLOCK_ROWS) for k in range(len(centroids))])
        #: Each row's block: a list of any size is dealt out by hash.
        deal = self.spark.createDataFrame([(k, int(c)) for k, c in enumerate(self.chunks)], "list int, chunks int")
        self.dealt = self.rows.join(F.broadcast(deal), "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).select("list", "chunk", "vec_id", "label", "v")

    def search(self, anchors: DataFrame, windows: str | None, k: int, name: str) -> DataFrame:
        """anchor_id, at, vec_id, score: for each window of an anchor (anchor_id, label, v, ``windows`` an array of top scores; None: one open window) its k best rows.

        With windows only rows of other labels count, with a score from 0.8 of the window's top to the top; without, only other rows of the same label.
        """
        scratch, dims, centroids, radius, chunks, negative = self.scratch, self.dims, self.centroids, self.radius, self.chunks, windows is not None
        anchors = anchors.select("anchor_id", "label", "v", (F.col(windows) if negative else F.array(F.lit(0).cast("long"))).alias("tops"))
        parts = max(1, -(-anchors.count() // ANCHOR_ROWS))
        deal = self.spark.createDataFrame([(p,) for p in range(parts)], "part int")
        blocks = self.dealt.crossJoin(F.broadcast(deal)) if parts > 1 else self.dealt.withColumn("part", F.lit(0))  # a list meets so many anchors at a time
        best, round_, start, many = None, 0, 0, FIRST
        out = "anchor_id long, at int, vec_id long, score long"

        def visits(start: int, end: int):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if not b.num_rows:
                        continue
                    t = b.to_pydict()
                    v = _matrix(t["v"], dims)
                    mid, size = v @ centroids.T, np.sqrt((v * v).sum(1))[:, None]
                    spread = np.where(chunks > 0, size * np.maximum(radius, 0) * (1 + 1e-9) + 1e-6, 0) + np.abs(mid) * 1e-9
                    high = np.where(chunks > 0, mid + spread, -np.inf)
                    low, order = mid - spread, np.argsort(-high, axis=1, kind="stable")
                    rows = []
                    for i in range(b.num_rows):
                        own = order[i, start:end]
                        least = np.array([-np.inf if x is None else x for x in t["kth"][i]])
                        fits = high[i, own][:, None] >= least[None, :]
                        if negative:
                            tops = np.array(t["tops"][i], np.float64)
                            fits &= (low[i, own][:, None] <= tops) & (high[i, own][:, None] >= 0.8 * tops)
                        rows += [(i, int(c), x) for c in own[fits.any(1)] for x in range(chunks[c])]
                    if rows:
                        i = pa.array([r[0] for r in rows], pa.int64())
                        part = pa.array([hash(x) % parts for x in t["anchor_id"]], pa.int32())
                        yield pa.RecordBatch.from_arrays([*(b.column(c).take(i) for c in ("anchor_id", "label", "v", "tops", "kth")), part.take(i), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=["anchor_id", "label", "v", "tops", "kth", "part", "list", "chunk"])

            return run

        def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found: list[tuple] = []
            if len(left) and len(right):
                right = right.sort_values("vec_id", kind="stable")
                ids, labels = right["vec_id"].to_numpy(), right["label"].to_numpy()
                rows = _matrix(list(right["v"]), dims)
                for a in range(0, len(left), 512):
                    some = left.iloc[a:a + 512]
                    s = products(_matrix(list(some["v"]), dims), rows)
                    for j, (anchor, label, tops, kth) in enumerate(zip(some["anchor_id"], some["label"], some["tops"], some["kth"])):
                        able = labels != label if negative else (labels == label) & (ids != anchor)
                        for at, (top, last) in enumerate(zip(tops, kth)):
                            ok = able if last is None or np.isnan(last) else able & (s[j] >= last)
                            if negative:
                                ok = ok & (100 * s[j] >= 80 * int(top)) & (s[j] <= int(top))
                            w = np.flatnonzero(ok)
                            w = w[np.argsort(-s[j, w], kind="stable")[:k]]
                            found += zip([anchor] * len(w), [at] * len(w), ids[w].tolist(), s[j, w].tolist())
            return pd.DataFrame(found, columns=["anchor_id", "at", "vec_id", "score"])

        open_ = F.transform("tops", lambda x: F.lit(None).cast("long"))
        while start < len(centroids):
            now = anchors.withColumn("kth", open_) if best is None else anchors.join(
                best.groupBy("anchor_id", "at").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("at", F.when(F.col("n") >= k, F.col("last")).alias("last")))).alias("m")), "anchor_id", "left",
            ).select("anchor_id", "label", "v", "tops", F.transform("tops", lambda x, i: F.element_at("m", i.cast("int"))).alias("kth"))
            asked = now.mapInArrow(visits(start, start + many), "anchor_id long, label long, v binary, tops array<long>, kth array<long>, part int, list int, chunk int")
            asked = scratch.table(asked, f"{name}-visits-{round_}")
            if best is not None and asked.isEmpty():
                scratch.drop(f"{name}-visits-{round_}")
                start, many, round_ = start + many, many * GROWTH, round_ + 1
                continue
            meet = asked.groupBy("list", "chunk", "part").cogroup(blocks.groupBy("list", "chunk", "part")).applyInPandas(scored, out)
            rows = meet if best is None else meet.unionByName(best)
            order = F.struct((-F.col("score")).alias("s"), "vec_id")
            # the first k of a window: at most k a list come in, and a window has so many lists at most
            firsts = F.slice(F.sort_array(F.collect_list(order)), 1, k)
            best = scratch.table(rows.groupBy("anchor_id", "at").agg(firsts.alias("b")).select("anchor_id", "at", F.explode("b").alias("b")).select("anchor_id", "at", F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score")), f"{name}-{round_}")
            scratch.drop(f"{name}-visits-{round_}", f"{name}-{round_ - 1}")
            start, many, round_ = start + many, many * GROWTH, round_ + 1
        return best


def hard_negatives(vectors: DataFrame, every: int = 100, wrong: int = 7, classes: int = 10, scale: float = 256.0, k: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without a vec_id, a label or a finite vector take no part (nor do vectors of
    another length than most). Scores are integer inner products; ties go to the
    smaller vec_id. Rows that share a vec_id are rows of their own, equal ones in any
    order; of those that share an anchor's vec_id the least by label and components is the
    anchor, and as an anchor's other rows count those of another vec_id. An anchor without
    positives, or a positive without rows in its window, gives no row; a negative
    positive score has an empty window. An empty table gives no rows. Labels may be
    any integers. A score that no long holds raises OverflowError.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "negatives")
    rows = scratch.table(prepared(vectors, wrong, classes, scale), "prepared")
    if rows.isEmpty():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    lists = Lists(rows, scratch)
    scratch.drop("prepared")
    anchors = lists.rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("r")).select("anchor_id", "r.*")
    positives = lists.search(anchors, None, k, "positives")
    tops = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_set("score"), asc=False).alias("tops"))  # k of an anchor
    negatives = lists.search(anchors.join(tops, "anchor_id"), "tops", k, "negatives")
    at = tops.select("anchor_id", F.posexplode("tops").alias("at", "positive_score"))
    ranked = negatives.groupBy("anchor_id", "at").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("n"))
    ranked = ranked.join(at, ["anchor_id", "at"]).select("anchor_id", "positive_score", F.posexplode("n").alias("rank", "n"))
    found = positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(ranked, ["anchor_id", "positive_score"])
    return found.select("anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", (-F.col("n.s")).alias("negative_score"))
