"""Blocks of documents, and questions that blocks put to keyed buckets.

A block is a compressed row of some megabytes of documents, written once. To
learn something about keys that many blocks share (how often a word occurs, who
holds a window first) a block sends each bucket one array of its own distinct
keys; the bucket joins what all blocks sent and answers each of them with an
array in the order it asked. A key that a third of all rows hold is thus sent
once a block, never once a row, and arrays travel where rows would otherwise. As
buckets follow the input and blocks don't, arrays get shorter with the input, and
at the extreme an array is one key: no more rows than a plain shuffle of the keys.
The number of tasks of an exchange follows the table of blocks too, so that a
task's share stays the same whatever the input.
"""

from __future__ import annotations

import io
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import Scratch, arrow_schema, batch, input_bytes, pick, ship, trim, units

#: Text of a block.
BLOCK_BYTES = 4 << 20
#: Of the table of blocks (compressed): bytes for one bucket, and for one task of an exchange.
BUCKET_BYTES, TASK_BYTES = 4 << 20, 16 << 20

BLOCK_ROWS = "block long, kind int, bucket int, payload binary"


def pack(*arrays) -> bytes:
    """Arrays (or numbers) as compressed bytes."""
    import zstandard

    out = io.BytesIO()
    for a in arrays:
        np.save(out, np.asarray(a), allow_pickle=False)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def unpack(raw: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(raw)
    held, found = io.BytesIO(data), []
    while held.tell() < len(data):
        found.append(np.load(held, allow_pickle=False))
    return found


def pack_block(doc_ids: list, texts: list[bytes]) -> bytes:
    """A block's documents as compressed bytes."""
    import zstandard

    rows = pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(texts, pa.large_binary())], names=["doc_id", "text"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as w:
        w.write_batch(rows)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def unpack_block(raw: bytes) -> tuple[list, list[bytes]]:
    """(doc_ids, texts) of a block."""
    import zstandard

    rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(raw)).read_all()
    return rows.column(0).to_pylist(), rows.column(1).to_pylist()


def dealt(df: DataFrame, key: str, like: DataFrame) -> DataFrame:
    """Dealt out by ``key`` into as many tasks as the table ``like`` asks for, the session's number at least (which Spark may then lower again)."""
    n = -(-input_bytes(like) // TASK_BYTES)
    if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(n, key)
    return df.repartition(key)


def blocks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents as a written table of blocks; ``unpack_block`` reads a payload."""
    ship(docs.sparkSession)
    schema = arrow_schema(BLOCK_ROWS)

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 20
        for k, (rest, texts) in enumerate(units(batches, limit=BLOCK_BYTES)):
            yield batch(schema, {"block": [base + k], "kind": [9], "bucket": [0], "payload": [pack_block(rest["doc_id"], texts)]})

    frame = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scratch.table(frame.mapInArrow(run, BLOCK_ROWS), "blocks", codec="none")


def bucket_bits(table: DataFrame) -> int:
    """log2 of the number of buckets: it follows the size of the table of blocks."""
    return min(31, max(4, int(np.ceil(np.log2(max(1, input_bytes(table) / BUCKET_BYTES))))))


def pieces(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of the buckets (by a key's highest bits) that sorted 64-bit keys are in; the others cost nothing."""
    if len(keys):
        own = (keys >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        yield from zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)])


def filled(out: np.ndarray, keys: np.ndarray, bits: int, replies: dict[int, bytes], read: Callable[[bytes, int], np.ndarray]) -> np.ndarray:
    """``out`` with each bucket's reply, read as so many values, in the places of its keys."""
    for bucket, a, b in pieces(keys, bits):
        if bucket in replies:
            out[a:b] = read(replies[bucket], b - a)
    return out


def bits_of(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows with the same key, which stand together."""
    rows = (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist())
    for k, found in itertools.groupby(rows, key=lambda r: r[key]):
        yield k, list(found)
    trim()


def asked(table: DataFrame, send: Callable[[tuple, dict], Iterable[tuple[int, bytes]]], replies: list[DataFrame] = ()) -> DataFrame:
    """``send(payload, {kind: {bucket: reply}})`` of every block: (bucket, payload) rows."""
    schema = arrow_schema(BLOCK_ROWS)

    def run(batches):
        for block, content, got in with_replies(batches):
            for bucket, raw in send(content, got):
                yield batch(schema, {"block": [block], "kind": [0], "bucket": [bucket], "payload": [raw]})

    return _beside(table, replies).mapInArrow(run, BLOCK_ROWS)


def answered(table: DataFrame, questions: DataFrame, answer: Callable[[int, list[int], list[bytes]], Iterable[tuple[int, bytes]]], kind: int = 0) -> DataFrame:
    """``answer(bucket, blocks, payloads)`` of every bucket that the blocks of ``table`` have sent ``questions`` to: (block, reply) rows."""
    schema = arrow_schema(BLOCK_ROWS)

    def run(batches):
        for bucket, rows in groups(batches, "bucket"):
            for block, raw in answer(bucket, [r["block"] for r in rows], [r["payload"] for r in rows]):
                yield batch(schema, {"block": [block], "kind": [kind], "bucket": [bucket], "payload": [raw]})

    return dealt(questions, "bucket", table).sortWithinPartitions("bucket", "block").mapInArrow(run, BLOCK_ROWS)


def told(table: DataFrame, replies: list[DataFrame], ddl: str, work: Callable[[tuple, dict], dict]) -> DataFrame:
    """``work(payload, {kind: {bucket: reply}})`` of every block: columns of ``ddl``."""
    return told_several(table, replies, ddl, lambda held: [work(*x) for x in held], 1)


def told_several(table: DataFrame, replies: list[DataFrame], ddl: str, work: Callable[[list[tuple]], Iterable[dict]], most: int) -> DataFrame:
    """``work([(payload, {kind: {bucket: reply}}), ...])`` of up to ``most`` blocks at a time: columns of ``ddl`` for each of them."""
    schema = arrow_schema(ddl)

    def run(batches):
        held = ((content, got) for _, content, got in with_replies(batches))
        for some in iter(lambda: list(itertools.islice(held, most)), []):
            for columns in work(some):
                yield batch(schema, columns)

    return _beside(table, replies).mapInArrow(run, ddl)


def _beside(table: DataFrame, replies: list[DataFrame]) -> DataFrame:
    """Each block after the replies to it."""
    if not replies:
        return table
    rows = table
    for r in replies:
        rows = rows.unionByName(r)
    return dealt(rows, "block", table).sortWithinPartitions("block", "kind", "bucket")


def with_replies(batches) -> Iterator[tuple[int, tuple, dict]]:
    rows = (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist())
    got: dict[int, dict[int, bytes]] = {}
    for r in rows:
        if r["kind"] == 9:
            yield r["block"], unpack_block(r["payload"]), got
            got = {}
        else:
            got.setdefault(r["kind"], {})[r["bucket"]] = r["payload"]
    trim()
