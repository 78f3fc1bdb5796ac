"""Vector codes: product quantisation by exact integer k-means.

Vectors are kept as columnar blocks (a matrix of integers for each of the equal
parts, components first). A round is one ``treeAggregate`` over the blocks: a task
adds the squared differences to the entries up component by component, scatters
its vectors' components into int64 sums and counts by ``np.add.at``, and the tensors
(parts x entries x components) are merged through a reduction tree. Integers add
up to the same in any order, so a lost task that runs again changes nothing.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import Scratch, ship, trim

#: Vectors of a block, and of one step within it (the differences to all entries are held at once).
BLOCK_ROWS, STEP_ROWS = 8192, 2048
#: Depth of the reduction tree; tables of label sums are dealt out in so many copies, so that a frequent label isn't one task.
DEPTH, SALTS = 3, 16
#: Components whose squared differences a long can add up.
LARGEST = 1 << 28


def prepared(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, v (array<long> of floor(scale x)) of the rows that are kept. The most frequent length (ties: the shorter) is the vectors' length; others are dropped."""
    rows = vectors.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`label`").cast("long").alias("label"), F.col("`embedding`").alias("x"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", number))
    usual = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("x") == (usual["n"] if usual else 0))
    return rows.select("vec_id", "label", F.transform("x", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _parts(v: np.ndarray, parts: int) -> np.ndarray:
    """(parts, components, vectors) of (vectors, dims); where the parts don't divide the length, zeros fill it up and change no distance."""
    if v.size and int(np.abs(v).max()) >= LARGEST:
        raise OverflowError(f"a component of {LARGEST} or more: its squared distances aren't longs")
    short = -v.shape[1] % parts
    if short:
        v = np.concatenate([v, np.zeros((len(v), short), np.int64)], axis=1)
    return np.ascontiguousarray(v.reshape(len(v), parts, -1).transpose(1, 2, 0))


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), each (parts, vectors): the nearest entries, ties to the lower index."""
    codes, errors = np.empty((len(block), block.shape[2]), np.int64), np.empty((len(block), block.shape[2]), np.int64)
    for p in range(len(block)):
        for a in range(0, block.shape[2], STEP_ROWS):
            x = block[p, :, a:a + STEP_ROWS]
            far = np.zeros((books.shape[1], x.shape[1]), np.int64)
            for k in range(len(x)):
                far += (x[k][None, :] - books[p, :, k][:, None]) ** 2
            codes[p, a:a + STEP_ROWS] = own = far.argmin(0)
            errors[p, a:a + STEP_ROWS] = far[own, np.arange(x.shape[1])]
    return codes, errors


def added(total: tuple[np.ndarray, np.ndarray], block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums and counts with a block's vectors."""
    sums, counts = total
    codes, _ = nearest(block, books)
    for p in range(len(block)):
        np.add.at(sums[p], codes[p], block[p].T)
        np.add.at(counts[p], codes[p], 1)
    return sums, counts


def moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries at the floor of their vectors' mean; unused ones stay."""
    return np.where(counts[:, :, None] > 0, np.floor_divide(sums, np.maximum(counts, 1)[:, :, None]), books)


def _packed(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def blocks_of(rows: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """A written table of blocks: vec_ids, labels, and the vectors' parts as one binary."""
    schema = pa.schema([("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BLOCK_ROWS):
                s = b.slice(a, BLOCK_ROWS)
                v = s.column("v").flatten().to_numpy(zero_copy_only=False).reshape(s.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array([s.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([s.column("label").to_pylist()], pa.list_(pa.int64())), pa.array([_packed(_parts(v, parts))], pa.binary())], schema=schema)
        trim()

    return scratch.table(rows.mapInArrow(run, "vec_ids array<long>, labels array<long>, payload binary"), "blocks")


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row.

    Rows whose vector is null or empty or holds a null or non-finite component go, and
    so do vectors of another length than most. Codebooks start as the parts of the
    first vectors by vec_id (none last, equal ones by their components; fewer entries
    where there are fewer rows). Rows that share a vec_id, and rows without one, are
    rows of their own. Labels may be null, which is a label. An empty table gives no
    rows; a component of 2**28 or more after scaling raises OverflowError.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "codes")
    rows = prepared(vectors, scale)
    blocks = blocks_of(rows, parts, scratch)
    first = [r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    if not first:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = np.ascontiguousarray(_parts(np.array(first, np.int64), parts).transpose(0, 2, 1))
    payloads = blocks.select("payload").rdd.map(lambda r: np.load(io.BytesIO(r["payload"]), allow_pickle=False))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)  # parts x entries x components
        zero = (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))
        sums, counts = payloads.treeAggregate(zero, lambda t, b, sent=sent: added(t, b, sent.value), lambda x, y: (x[0] + y[0], x[1] + y[1]), DEPTH)
        books = moved(books, sums, counts)
        sent.unpersist()
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    dims = len(first[0])
    if dims % parts:  # without the zeros that fill up the last parts
        width = -(-dims // parts)
        digest = hashlib.sha256(",".join(str(x) for p in range(parts) for e in books[p] for x in e[:max(0, min(width, dims - p * width))].tolist()).encode()).hexdigest()
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1)
                codes, errors = nearest(np.load(io.BytesIO(r.column("payload")[0].as_py()), allow_pickle=False), books)
                text = [x.tobytes().hex() for x in codes.T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([r.column("vec_ids").flatten(), r.column("labels").flatten(), pa.array(text), pa.array(errors.sum(0))], schema=schema)
        trim()

    found = scratch.table(blocks.mapInArrow(coded, "vec_id long, label long, code string, error long"), "coded")
    scratch.drop("blocks")
    none, name = F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0).cast("long")).alias("name")
    total = found.groupBy(none, name).agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = found.select("vec_id", "code", "error", none, name, F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.join(total, ["none", "name", "salt"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
