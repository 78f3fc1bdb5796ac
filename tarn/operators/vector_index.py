"""Approximate vector search: inverted lists, product codes, exact re-ranking.

Centroids and codebooks are fitted on a bounded sample; every vector is put into the
list of its nearest centroid and keeps a code, a byte for every WIDTH numbers of what
its centroid leaves of it. A query looks at the lists of its nearest centroids only,
scores the vectors that their codes stand for, and the best of these are scored exactly
from their vectors. A code is fine enough that this choice hardly loses a neighbour
however many vectors there are: with a byte for four numbers a tenth were lost among
50,000. ``vectors.nearest`` is the exact way, which needs no index.

The tables are the caller's to write: ``codes`` sorted by list, so that row groups'
statistics skip lists that no query probes; the fitted numbers are a small object.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.vectors import ROWS, asked_blocks, cosine_distance, rare

#: Vectors that centroids and codebooks are fitted on, at most; rounds of the fit; lists at most.
SAMPLE, ROUNDS, LISTS = 20_000, 10, 4096
#: Numbers of a vector that a code's byte stands for, and entries of a codebook; how many times k candidates are scored exactly; codes of a block.
WIDTH, ENTRIES, REFINED, CODES = 2, 64, 16, 32_768
#: The share of the TRIED_K nearest of TRIED sampled vectors that the probed lists have to hold: it decides how many lists a query probes.
HELD, TRIED, TRIED_K = 0.96, 200, 10


@dataclass
class Fitted:
    """Centroids (lists x dims), codebooks (parts x entries x dims of a part) of what they leave, and how many lists a query probes."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]


def _units(x: pa.Array, dims: int) -> np.ndarray:
    """Rows as unit vectors; zeros stay."""
    v = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), dims)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1)


def _lloyd(v: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = v[rng.choice(len(v), min(k, len(v)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = _closest(v, c)
        total, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(total, own, v)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _closest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None, :] - 2 * (v @ c.T), axis=1)


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """Rows with a vector of this size and only numbers in it."""
    return vectors.where((F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))


def fit(vectors: DataFrame, keys: Iterable[str] = ("vec_id",), lists: int | None = None, seed: int = 0) -> Fitted:
    """Fitted on SAMPLE vectors at most, chosen by a hash of their keys; by default as many lists as the square root of the number of vectors (LISTS at most)."""
    keys, first = list(keys), vectors.where("size(embedding) > 0").select(F.size("embedding").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if first is None:
        raise ValueError("no vectors to fit an index on")
    rows = usable(vectors, first["n"])
    n = lists or max(1, min(LISTS, round(rows.count() ** 0.5)))
    drawn = rows.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(SAMPLE).select(F.col("embedding").cast("array<double>").alias("embedding")).toArrow()
    v, rng = _units(drawn["embedding"].combine_chunks(), first["n"]), np.random.default_rng(seed)
    centroids = _lloyd(v, n, rng)
    left = v - centroids[_closest(v, centroids)]
    parts = v.shape[1] // (WIDTH if v.shape[1] % WIDTH == 0 else 1)
    return Fitted(centroids, np.stack([_pad(_lloyd(x, ENTRIES, rng)) for x in np.split(left, parts, axis=1)]), _probes(v, centroids))


def _probes(v: np.ndarray, centroids: np.ndarray) -> int:
    """How many lists, nearest first, hold HELD of sampled vectors' nearest others: vectors that don't cluster need many."""
    q = v[np.linspace(0, len(v) - 1, min(TRIED, len(v))).astype(int)]
    near = np.argsort(-(q @ v.T), axis=1, kind="stable")[:, 1:TRIED_K + 1]
    order = np.argsort((centroids ** 2).sum(1)[None, :] - 2 * q @ centroids.T, axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(place, _closest(v, centroids)[near], 1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(HELD * len(needed)))]) if len(needed) else len(centroids)


def _pad(book: np.ndarray) -> np.ndarray:
    return np.concatenate([book, np.repeat(book[:1], ENTRIES - len(book), axis=0)])


def coded(vectors: DataFrame, fitted: Fitted, keys: Iterable[str] = ("vec_id",)) -> DataFrame:
    """keys, list, code of every usable vector."""
    keys, kinds = list(keys), dict(vectors.dtypes)
    width = fitted.dims // len(fitted.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _units(b.column("embedding"), fitted.dims)
                own = _closest(v, fitted.centroids)
                left = v - fitted.centroids[own]
                codes = np.stack([_closest(left[:, p * width:(p + 1) * width], book) for p, book in enumerate(fitted.books)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=[*keys, "list", "code"])

    return usable(vectors, fitted.dims).select(*keys, "embedding").mapInArrow(run, "".join(f"{k} {kinds[k]}, " for k in keys) + "list int, code binary")


def nearest(codes: DataFrame, vectors: DataFrame, fitted: Fitted, queries: DataFrame, k: int, keys: Iterable[str] = ("vec_id",), probes: int | None = None, refined: int = REFINED) -> DataFrame:
    """query_id, the keys, distance: about the k nearest rows to each of ``queries`` (query_id, embedding); distances are exact. Queries without a usable, non-zero vector find nothing.

    Of equal vectors one is looked for by its code, and the k with the smallest keys are scored exactly.
    """
    keys = list(keys)
    asked = usable(queries, fitted.dims).where(F.exists("embedding", lambda x: x != 0)).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    members = rare(usable(vectors.select(*keys, "embedding"), fitted.dims), k, keys)
    firsts = members.where(F.struct(*keys) == F.col("first")).select(*keys)
    found = _candidates(codes.join(firsts, keys, "left_semi"), fitted, asked, k * refined, keys, probes or fitted.probes)
    close = found.select("query_id", F.struct(*keys).alias("first")).join(asked.withColumnRenamed("embedding", "asked"), "query_id")
    exact = close.join(members, "first").select("query_id", *keys, cosine_distance(F.col("embedding"), F.col("asked")).alias("distance"))
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 12), *keys)
    return exact.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def _code_blocks(codes: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of CODES codes, near lists together: rows (keys and list, an array of structs), codes (one after the other)."""
    kinds, names = dict(codes.dtypes), [*keys, "list"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            own = pa.StructArray.from_arrays([t[c].combine_chunks() for c in names], names=names)
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([b"".join(t["code"].to_pylist())], pa.binary())], names=["rows", "codes"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if sum(x.num_rows for x in held) + b.num_rows > CODES and held:
                yield block(held)
                held = []
            if b.num_rows:
                held.append(b)
        if held:
            yield block(held)

    dealt = codes.select(*names, "code").repartitionByRange(max(1, -(-codes.count() // CODES)), "list", *keys).sortWithinPartitions("list")
    return dealt.mapInArrow(run, f"rows array<struct<{','.join(f'`{c}`:{kinds[c]}' for c in names)}>>, codes binary")


def _candidates(codes: DataFrame, fitted: Fitted, asked: DataFrame, n: int, keys: list[str], probes: int) -> DataFrame:
    """query_id, keys: the n rows of the probed lists whose codes promise most. Blocks of codes meet blocks of queries; a task holds one pair of blocks and some thousand decoded vectors."""
    kinds, step = dict(codes.dtypes), ROWS
    centroids, books = fitted.centroids.astype(np.float32), fitted.books.astype(np.float32)
    norms, parts = (centroids**2).sum(1), np.arange(len(fitted.books))

    def best(lists: np.ndarray, code: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Promise and row of the n best rows of each query, by falling promise; minus infinity where there are fewer."""
        far = norms[None, :] - 2 * (q @ centroids.T)
        probed = far <= np.partition(far, probes - 1, axis=1)[:, probes - 1 : probes] if probes < far.shape[1] else np.ones(far.shape, bool)
        wanted = np.flatnonzero(probed.any(0)[lists])
        top, at = np.full((len(q), 0), -np.inf, np.float32), np.zeros((len(q), 0), np.int64)
        for a in range(0, len(wanted), step):
            rows = wanted[a : a + step]
            v = books[parts, code[rows]].reshape(len(rows), -1)
            v += centroids[lists[rows]]
            s = np.where(probed[:, lists[rows]], q @ v.T, -np.inf)
            top, at = np.concatenate((top, s), 1), np.concatenate((at, np.broadcast_to(rows, s.shape)), 1)
            if top.shape[1] > n:
                some = np.argpartition(-top, n - 1, axis=1)[:, :n]
                top, at = np.take_along_axis(top, some, 1), np.take_along_axis(at, some, 1)
        return top, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                own, ids = b.column("rows")[k].values, b.column("q_rows")[k].values.field("query_id").to_numpy()
                code = np.frombuffer(b.column("codes")[k].as_buffer(), np.uint8).reshape(len(own), -1)
                q = np.frombuffer(b.column("q_numbers")[k].as_buffer()).reshape(len(ids), -1)
                top, at = best(own.field("list").to_numpy(), code, (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32))
                i, j = np.nonzero(top > -np.inf)
                chosen = own.take(pa.array(at[i, j]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), *(chosen.field(c) for c in keys), pa.array(top[i, j].astype(np.float64))], names=["query_id", *keys, "promise"])

    cores = codes.sparkSession.sparkContext.defaultParallelism
    pairs = _code_blocks(codes, keys).crossJoin(asked_blocks(asked)).repartition(2 * cores)  # small ones: a row's code has a byte for WIDTH numbers
    near = pairs.mapInArrow(run, "query_id long, " + "".join(f"{c} {kinds[c]}, " for c in keys) + "promise double")
    w = Window.partitionBy("query_id").orderBy(F.desc("promise"), *keys)
    return near.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).select("query_id", *keys)


def recall(found: DataFrame, exact: DataFrame, keys: Iterable[str] = ("vec_id",)) -> DataFrame:
    """n_queries, n_exact, recall: which share of the exact neighbours was found."""
    keys = list(keys)
    hits = exact.select("query_id", *keys).join(found.select("query_id", *keys, F.lit(1).alias("hit")), ["query_id", *keys], "left")
    return hits.agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_exact"), (F.coalesce(F.sum("hit"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("recall"))
