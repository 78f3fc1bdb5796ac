"""Greedy batches in one global order, filled in parallel.

A batch takes rows in order until the next would be one too many or too many bytes (a
row that is too large by itself is a batch of its own). Where a batch begins hangs on
the one before it, but only through one number: cut into tiles of as many rows as a
batch may have, a tile maps the offset at which the first batch begins in it to that in
the next tile, and to how many batches begin in it. Such maps compose, so the tiles'
true offsets follow by doubling: a round tells those of twice as many tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _map_of(own: list[int], after: list[int], most_docs: int, most_bytes: int) -> tuple[list[int], list[int]]:
    """Of each offset in a tile: the offset in the next tile of the first batch that doesn't begin here, and the batches that do."""
    sizes, begin, n = own + after, [0] * most_docs, [0] * most_docs
    end = size = 0
    ends = []
    for o in range(most_docs):  # where the batch that begins at o ends: both ends only move forward
        end, size = (end, size) if end > o else (o, 0)
        while end < len(sizes) and end - o < most_docs and (end == o or size + sizes[end] <= most_bytes):
            size += sizes[end]
            end += 1
        ends.append(max(end, o + 1))
        size -= sizes[o] if o < len(sizes) else 0
    for o in reversed(range(most_docs)):
        e = ends[o]
        begin[o], n[o] = (begin[e], n[e] + 1) if e < most_docs else (e - most_docs, 1)
    return begin, n


def _starts(own: list[int], first: int, most_docs: int, most_bytes: int) -> list[int]:
    """How many batches have begun in a tile up to each of its rows."""
    out, begun, n, size = [], 0, 0, 0
    for k, b in enumerate(own):
        if k == first or (k > first and (n >= most_docs or size + b > most_bytes)):
            begun, n, size = begun + 1, 0, 0
        n, size = n + 1, size + b
        out.append(begun)
    return out


def greedy_batches(rows: DataFrame, order: list[str], most_docs: int, most_bytes: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (with n_bytes; null counts as 0) and the number of each row's ``batch``, from 0 in the order of the columns ``order``.

    ``keep`` writes a frame and reads it back (``Warehouse.staged``, ``DataFrame.checkpoint``).
    Rows that the order doesn't tell apart stand in some order. No rows give no batches.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = keep(sorted_.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    offsets, total = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):  # one number a partition
        offsets.append((part, total))
        total += n
    if not total:
        return rows.withColumn("batch", F.lit(0).cast("long"))
    shift = rows.sparkSession.createDataFrame(offsets, "_part int, _before long")
    pos = F.col("_before") + F.col("_at")
    placed = placed.join(F.broadcast(shift), "_part").withColumn("_tile", F.floor(pos / most_docs)).withColumn("_k", (pos % most_docs).cast("int")).drop("_part", "_at", "_before")
    own = placed.groupBy("_tile").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", F.coalesce("n_bytes", F.lit(0)).cast("long").alias("b")))), lambda x: x["b"]).alias("own"))  # most_docs rows at most
    own = keep(own)
    after = own.select((F.col("_tile") - 1).alias("_tile"), F.col("own").alias("after"))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.to_pydict()
            made = [_map_of(x, y or [], most_docs, most_bytes) for x, y in zip(t["own"], t["after"])]
            yield pa.RecordBatch.from_arrays([b.column("_tile"), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.int64()))], names=["_tile", "begin", "n"])

    step = keep(own.join(after, "_tile", "left").select("_tile", "own", "after").mapInArrow(maps, "_tile long, begin array<int>, n array<long>"))
    known = rows.sparkSession.createDataFrame([(0, 0, 0)], "_tile long, first int, begun long")
    tiles, reach = -(-total // most_docs), 1
    while reach < tiles:
        jump = known.join(step, "_tile").select((F.col("_tile") + reach).alias("_tile"), F.get("begin", F.col("first")).alias("first"), (F.col("begun") + F.get("n", F.col("first"))).alias("begun"))
        known = keep(known.unionByName(jump).where(F.col("_tile") < tiles))
        far = step.select((F.col("_tile") - reach).alias("_tile"), F.col("begin").alias("begin2"), F.col("n").alias("n2"))
        both = step.join(far, "_tile")
        step = keep(both.select("_tile", F.transform("begin", lambda x: F.get("begin2", x)).alias("begin"), F.zip_with("n", "begin", lambda n, x: n + F.get("n2", x)).alias("n")))
        reach *= 2

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.to_pydict()
            made = [[begun + s - 1 for s in _starts(x, first, most_docs, most_bytes)] for x, first, begun in zip(t["own"], t["first"], t["begun"])]
            yield pa.RecordBatch.from_arrays([b.column("_tile"), pa.array(made, pa.list_(pa.int64()))], names=["_tile", "batches"])

    told = own.join(known, "_tile").select("_tile", "own", "first", "begun").mapInArrow(numbers, "_tile long, batches array<long>")
    return placed.join(told, "_tile").withColumn("batch", F.get("batches", F.col("_k"))).drop("_tile", "_k", "batches")
