"""Exact cosine search over chunk vectors, for one query or a set of them.

A set of queries may grow with the rows: blocks of queries are joined with blocks
of rows, each pair of blocks keeping the best of a query, so what is shuffled is
about k rows a query and block, cut to k a query before the shuffle where Spark
can. Every query meets every row, so the work is the product of both; what a task
holds is one pair of blocks. Arithmetic is in doubles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.ranking import best_of_file, ranked, top_of_each

#: Queries and rows that are held against each other at once; distances this near are held to be equal, the keys deciding.
QUERIES, ROWS, TIE = 512, 4096, 1e-11


class DimensionError(ValueError):
    """Vectors of another size than the index has."""


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in JVM expressions; infinity where a norm is 0 or the sizes differ."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norms = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(float("inf"))).otherwise(1 - product(a, b) / norms)


def _cosines(x: pa.Array, q: np.ndarray) -> np.ndarray:
    """Cosine of vectors with one; minus infinity where a norm is 0 or the size differs."""
    right = pc.fill_null(pc.equal(pc.list_value_length(x), len(q)), False)
    v = x.filter(right).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(1, len(q)))
    with np.errstate(divide="ignore", invalid="ignore"):
        s = v @ q / (np.sqrt((v * v).sum(1)) * np.sqrt(q @ q)) if len(q) else np.zeros(0)
    out = np.full(len(x), -np.inf)
    out[right.to_numpy(zero_copy_only=False)] = np.where(np.isfinite(s), s, -np.inf)
    return out


def similarities(embedding: Column, queries: list[list[float]]) -> Column:
    """An array: the cosine with each of some vectors, in Arrow batches (the numbers of a batch are one matrix). Minus infinity where a norm is 0 or the size differs."""
    asked = [np.array(q, np.float64) for q in queries]

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        s = np.stack([_cosines(x, q) for q in asked], 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(asked), pa.int32()), pa.array(s.ravel()))

    return run(embedding)


def similarity(embedding: Column, query: list[float]) -> Column:
    """The cosine with one vector."""
    return similarities(embedding, [query])[0]


def check_dimensions(vectors: DataFrame, dims: int) -> None:
    """Raise where any vector has another size."""
    odd = vectors.where(F.size("embedding") != dims).limit(1).collect()
    if odd:
        raise DimensionError(f"vectors of {len(odd[0]['embedding'])} numbers, the index has {dims}")


def packed(rows: DataFrame, most: int, keys: Iterable[str], numbers: str = "embedding") -> DataFrame:
    """Rows in blocks of at most ``most``: dims, rows (the other columns, an array of structs), numbers (their vectors in doubles, one after the other). A block has vectors of one size, none is empty."""
    keys, kinds = list(keys), dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.fill_null(pc.list_value_length(b.column(numbers)), 0).to_numpy(zero_copy_only=False)
            for dims in np.unique(size[size > 0]):
                at = np.flatnonzero(size == dims)
                for first in range(0, len(at), most):
                    some = b.take(pa.array(at[first : first + most]))
                    own = pa.StructArray.from_arrays([some.column(c) for c in keys], names=keys)
                    x = some.column(numbers).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([x.tobytes()], pa.binary())], names=["dims", "rows", "numbers"])

    fields = ",".join(f"`{c}`:{kinds[c]}" for c in keys)
    return rows.select(*keys, numbers).mapInArrow(run, f"dims int, rows array<struct<{fields}>>, numbers binary")


def asked_blocks(queries: DataFrame) -> DataFrame:
    """Blocks of QUERIES queries (query_id, embedding): q_dims, q_rows, q_numbers."""
    n = queries.count()
    blocks = packed(queries.repartition(max(1, n // (8 * QUERIES))), QUERIES, ["query_id"])
    return blocks.select(*(F.col(c).alias(f"q_{c}") for c in blocks.columns))


def rare(vectors: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """keys, embedding, first (the smallest keys of an equal vector): of equal vectors the k with the smallest keys, as no others can be among the k nearest."""
    w = Window.partitionBy("embedding").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = vectors.where("size(embedding) > 0").select(*keys, "embedding", F.first(F.struct(*keys)).over(w).alias("first"), F.row_number().over(w).alias("_copy"))
    return ranked.where(F.col("_copy") <= k).drop("_copy")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, keys: Iterable[str] = ("vec_id",)) -> DataFrame:
    """query_id, the keys, distance: the k nearest rows of ``vectors`` to each of ``queries`` (query_id, embedding), ties to the smaller keys.

    A query without a vector, with a null or non-number in it, or of length 0 or norm 0 has no direction and finds nothing;
    queries of several sizes each find rows of their own size. Rows without a direction are nobody's neighbours.
    Blocks of rows meet blocks of queries in the executors; neither passes through the driver.
    """
    keys, kinds = list(keys), dict(vectors.dtypes)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    able = queries.where(F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0)).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    ddl = "query_id long, " + "".join(f"{c} {kinds[c]}, " for c in keys) + "distance double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                dims = b.column("dims")[at].as_py()
                if dims != b.column("q_dims")[at].as_py():
                    continue
                own, ids = b.column("rows")[at].values, b.column("q_rows")[at].values.field("query_id").to_numpy()
                v, q = (np.frombuffer(b.column(c)[at].as_buffer()).reshape(-1, dims) for c in ("numbers", "q_numbers"))
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = 1 - (q @ v.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :])
                d[~np.isfinite(d)] = np.inf
                # a block's k smallest of each query and what ties with the last of them: the ranks below decide among these
                last = min(k, d.shape[1]) - 1
                edge = np.partition(d, last, axis=1)[:, last]
                j, i = np.nonzero((d <= edge[:, None] + TIE) & (d < np.inf))
                chosen = own.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([pa.array(ids[j], pa.int64()), *(chosen.field(c) for c in keys), pa.array(d[j, i])], names=["query_id", *keys, "distance"])

    blocks = packed(rare(vectors, k, keys), ROWS, keys).repartition(2 * vectors.sparkSession.sparkContext.defaultParallelism)
    near = blocks.crossJoin(asked_blocks(able)).mapInArrow(run, ddl)
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 12), *keys)
    return near.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def nearest_bodies(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, hash, seq, distance: the k nearest bodies to each query, by the best chunk of each (``chunks``: hash, seq, embedding). A body has any number of chunks among the nearest, so as many chunks are asked for as k bodies can own."""
    chunks = chunks.select("hash", "seq", "embedding")
    most = chunks.groupBy("hash").count().agg(F.max("count")).first()[0] or 1
    near = nearest(chunks, queries, k * most, ["hash", "seq"])
    best = near.groupBy("query_id", "hash").agg(F.min(F.struct("distance", "seq")).alias("b")).select("query_id", "hash", "b.seq", "b.distance")
    edge = best.withColumn("_rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.round("distance", 12))))
    return edge.where(F.col("_rank") <= k).drop("_rank")  # with all that tie with the last


def _best_chunks(vectors: DataFrame, query: list[float]) -> DataFrame:
    """hash, seq, pos, score of each body's nearest chunk, the first of equals."""
    scored = vectors.select("hash", "seq", "pos", similarity(F.col("embedding"), query).alias("score"))
    order = F.struct(F.round("score", 12).alias("s"), (-F.col("seq")).alias("q"))
    return scored.groupBy("hash").agg(F.max_by(F.struct("seq", "pos", "score"), order).alias("b")).select("hash", "b.*")


def search_vectors(vectors: DataFrame, docs: DataFrame, query: list[float], limit: int = 20, collections: list[str] | None = None) -> DataFrame:
    """The documents whose best chunk is nearest, with score 1 - distance; exact, also within collections.

    ``vectors``: hash, seq, pos, embedding. A chunk stands for every document with its hash. Only the best chunk of a body leaves a task.
    """
    wanted = docs.select("doc_id", "collection", "path", "title", "hash")
    if collections:
        wanted = wanted.where(F.col("collection").isin(collections))
    best = _best_chunks(vectors, query)
    return best.join(wanted, "hash").orderBy(F.desc(F.round("score", 12)), "doc_id").limit(limit).select("doc_id", "collection", "path", "title", "hash", "seq", "pos", "score")


def search_vectors_all(vectors: DataFrame, docs: DataFrame, queries: list[list[float]], limit: int = 20, collections: list[str] | None = None) -> DataFrame:
    """What ``search_vectors`` gives for each of some queries, by ``query`` (its number) and in order: one pass over the vectors."""
    wanted = docs.select("doc_id", "collection", "path", "title", "hash")
    if collections:
        wanted = wanted.where(F.col("collection").isin(collections))
    scored = vectors.select("hash", "seq", "pos", F.posexplode(similarities(F.col("embedding"), queries)).alias("query", "score"))
    order = F.struct(F.round("score", 12).alias("s"), (-F.col("seq")).alias("q"))
    best = scored.groupBy("query", "hash").agg(F.max_by(F.struct("seq", "pos", "score"), order).alias("b")).select("query", "hash", "b.*")
    found = ranked(best.join(wanted, "hash"), ["query"], "_rank").where(F.col("_rank") < limit)
    return found.orderBy("query", "_rank").select("query", "doc_id", "collection", "path", "title", "hash", "seq", "pos", "score")


def search_vectors_each(vectors: DataFrame, docs: DataFrame, query: list[float], limit: int, collections: list[str]) -> DataFrame:
    """Every collection's best ``limit``, merged by the best score of a file, then the best ``limit``."""
    wanted = docs.where(F.col("collection").isin(collections))
    best = _best_chunks(vectors, query)
    found = best.join(wanted.select("doc_id", "collection", "path", "title", "hash"), "hash").select("doc_id", "collection", "path", "title", "hash", "seq", "pos", "score")
    found = best_of_file(top_of_each(found, ["collection"], limit), ["collection", "path"])
    return found.orderBy(F.desc(F.round("score", 12)), "doc_id").limit(limit)


def check_samples(stored: DataFrame, fresh: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """hash, seq, distance, ok: stored vectors against vectors made again from the same chunks (hash, seq, embedding)."""
    again = fresh.select("hash", "seq", F.col("embedding").alias("again"))
    d = cosine_distance(F.col("embedding"), F.col("again"))
    return stored.join(again, ["hash", "seq"]).select("hash", "seq", d.alias("distance"), (d <= tolerance).alias("ok"))


def sample(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows in an order that only the seed and the rows' keys (hash, seq) decide."""
    return rows.orderBy(F.xxhash64("hash", "seq", F.lit(seed))).limit(n)
