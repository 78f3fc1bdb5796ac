"""Token-id output: shard files of separately compressed documents.

A dictionary is trained once on serialized id arrays (a bounded sample:
``SAMPLE_DOCS`` documents, those with the smallest hash of doc_id, of each as many
evenly spaced pieces as ``SAMPLE_BYTES`` hold). It only sets how small the files are. Documents are range-partitioned and sorted by doc_id,
so the files in name order and each file's documents in file order are in
ascending doc_id order.

A shard (little-endian):

    "TARNIDS1"                      magic, 8 bytes
    u64 length                      of the whole shard up to the closing mark
    32 bytes                        SHA-256 of the dictionary
    u8 width, 3 zero bytes          bytes of an id: 2 or 4
    u32 n                           documents
    n zstd frames                   one for each document
    n index rows                    i64 doc_id, u64 offset, u32 length, u32 null flag, u64 n_tokens
    u64 offset                      of the index
    "TARNEND1"                      closing mark, 8 bytes

A short document is read with its index row and its frame alone. Files are
written by Spark's own text writer (a shard is a line, the closing mark the line
end), so any file system that Spark writes to will do, and the commit protocol
drops what a lost executor had begun.

Extra columns are ignored. A very long text is a frame like any other, held whole
by one task. Null texts count as empty: the end id alone. Null doc_ids come first. Repeated
rows are written each. An empty table gives an empty folder and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.shared import Scratch, arrow_schema, batch, input_bytes, pick, ship, units
from tarn.llm.wordpieces import Whole, WordTable, by_strings, load

MAGIC, CLOSE = b"TARNIDS1", b"TARNEND1"
HEAD = struct.Struct("<8sQ32sB3xI")
ROW = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("null", "<u4"), ("n_tokens", "<u8")])
#: Bound of the dictionary's sample, and of the dictionary.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_PIECE, DICTIONARY_BYTES = 512, 8192, 512, 65536
#: Input for one file, and the frames of a shard after which another begins.
FILE_BYTES, SHARD_BYTES = 4 << 20, 16 << 20
LEVEL = 3
#: Files whose token counts are first added up in parallel.
GROUP = 1000

_TABLES: dict = {}


def _ids(tokenizer: str, kind: str) -> WordTable | Whole:
    if (tokenizer, kind) not in _TABLES:
        _TABLES[tokenizer, kind] = WordTable(tokenizer, {}, kind) if by_strings(tokenizer) else Whole(tokenizer, kind)
    return _TABLES[tokenizer, kind]


def _serialized(texts: list[bytes], tokenizer: str, kind: str, end_id: int) -> list[bytes]:
    end = np.array([end_id], kind).tobytes()
    return [x + end for x in _ids(tokenizer, kind).values(texts)]


def train_dictionary(docs: DataFrame, tokenizer: str, kind: str, end_id: int) -> bytes:
    """A zstd dictionary of at most DICTIONARY_BYTES from the bounded sample; the sample itself where it is too small to train on."""
    import zstandard

    ship(docs.sparkSession)
    at = F.xxhash64("doc_id")
    first = docs.select(at.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if first is None:
        return b""

    def run(batches):
        for _, texts in units(batches):
            for s in _serialized(texts, tokenizer, kind, end_id):
                yield batch(arrow_schema("ids binary"), {"ids": [_pieces(s)]})

    found = docs.where(at <= first).select("text").mapInArrow(run, "ids binary").limit(2 * SAMPLE_DOCS).collect()
    sample = sorted(bytes(r[0]) for r in found)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES]


def _pieces(ids: bytes) -> bytes:
    """At most SAMPLE_BYTES of an array, from all over it."""
    n = SAMPLE_BYTES // SAMPLE_PIECE
    if len(ids) <= SAMPLE_BYTES:
        return ids
    return b"".join(ids[a : a + SAMPLE_PIECE] for a in (k * (len(ids) - SAMPLE_PIECE) // (n - 1) // 4 * 4 for k in range(n)))


def _zstd(dictionary: bytes):
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known), zstandard.ZstdDecompressor(dict_data=known)


def shard(doc_ids: list, frames: list[bytes], n_tokens: list[int], dictionary: bytes, width: int) -> bytes:
    """The bytes of a shard without the closing mark."""
    rows = np.zeros(len(frames), ROW)
    lengths = np.array([len(f) for f in frames], np.int64)
    rows["doc_id"] = [d or 0 for d in doc_ids]
    rows["null"] = [d is None for d in doc_ids]
    rows["length"], rows["n_tokens"] = lengths, n_tokens
    rows["offset"] = HEAD.size + np.cumsum(lengths) - lengths
    index_at = HEAD.size + int(lengths.sum())
    total = index_at + rows.nbytes + 8
    return HEAD.pack(MAGIC, total, hashlib.sha256(dictionary).digest(), width, len(frames)) + b"".join(frames) + rows.tobytes() + struct.pack("<Q", index_at)


def shards(content: bytes) -> Iterator[bytes]:
    """The shards of a file."""
    at = 0
    while at < len(content):
        magic, total, *_ = HEAD.unpack_from(content, at)
        if magic != MAGIC or content[at + total : at + total + 8] != CLOSE:
            raise ValueError("not a shard, or a damaged one")
        yield content[at : at + total]
        at += total + 8


def dictionary_of(one: bytes) -> bytes:
    """SHA-256 of the dictionary that a shard was written with."""
    return HEAD.unpack_from(one)[2]


def index_of(one: bytes) -> np.ndarray:
    """The offset index of a shard."""
    n = HEAD.unpack_from(one)[4]
    return np.frombuffer(one, ROW, n, struct.unpack("<Q", one[-8:])[0])


def document(one: bytes, row: np.void, dictionary: bytes, unzip=None) -> np.ndarray:
    """One document's ids, from its frame alone. The dictionary must be the one the shard names."""
    _, _, digest, width, _ = HEAD.unpack_from(one)
    if unzip is None:
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("another dictionary than the shard was written with")
        unzip = _zstd(dictionary)[1]
    raw = unzip.decompress(one[row["offset"] : row["offset"] + row["length"]])
    return np.frombuffer(raw, f"<u{width}")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> bytes:
    """Write all documents below ``path``; returns the dictionary, which is also at ``path``/dictionary."""
    spark = docs.sparkSession
    ship(spark)
    docs = pick(docs, "doc_id", "text")
    width = 2 if load(tokenizer).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    kind = f"<u{width}"
    dictionary = train_dictionary(docs, tokenizer, kind, end_id)
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").write.parquet(f"{path}/dictionary")

    def run(batches):
        schema = arrow_schema("shard binary")
        zip_ = _zstd(shared.value)[0]
        ids, frames, sizes, held = [], [], [], 0
        for rest, texts in units(batches):
            raw = _serialized(texts, tokenizer, kind, end_id)
            ids += rest["doc_id"]
            sizes += [len(r) // width for r in raw]
            frames += [zip_.compress(r) for r in raw]
            held += sum(map(len, frames[-len(raw) :]))
            if held >= SHARD_BYTES:
                yield batch(schema, {"shard": [shard(ids, frames, sizes, shared.value, width)]})
                ids, frames, sizes, held = [], [], [], 0
        if frames:
            yield batch(schema, {"shard": [shard(ids, frames, sizes, shared.value, width)]})

    parts = max(4, -(-input_bytes(docs) // FILE_BYTES))
    ordered = docs.repartitionByRange(parts, F.col("doc_id").asc()).sortWithinPartitions("doc_id", "text")
    lines = ordered.mapInArrow(run, "shard binary").select(F.col("shard").cast("string").alias("value"))
    lines.write.option("lineSep", CLOSE.decode()).option("compression", "none").text(f"{path}/shards")
    return dictionary


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read from the files below ``path``."""
    ship(spark)
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()[0])
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES
    ddl = "file int, doc_id long, before long, n_tokens long, ids_crc32 long"

    def run(batches):
        schema = arrow_schema(ddl)
        unzip = _zstd(shared.value)[1]
        name = hashlib.sha256(shared.value).digest()
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                before = 0
                for one in shards(content):
                    if dictionary_of(one) != name:
                        raise ValueError("another dictionary than the shard was written with")
                    rows = index_of(one)
                    n = rows["n_tokens"].astype(np.int64)
                    crc = [zlib.crc32(document(one, r, shared.value, unzip).astype("<u4").tobytes()) for r in rows]
                    yield batch(schema, {
                        "file": [file] * len(rows), "doc_id": [None if r["null"] else int(r["doc_id"]) for r in rows],
                        "before": before + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": crc,
                    })
                    before += int(n.sum())

    files = spark.read.format("binaryFile").load(f"{path}/shards/part-*")
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    docs = Scratch(spark, "ids").table(files.select(number.alias("file"), "content").mapInArrow(run, ddl), "docs")
    # a row a file, then a row for GROUP files: the running total over these is the only global order
    group = F.floor(F.col("file") / GROUP)
    totals = docs.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("group", group)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = totals.groupBy("group").agg(F.sum("n").alias("n")).select("group", before(Window.orderBy("group")).alias("group_first"))
    starts = totals.select("file", "group", before(Window.partitionBy("group").orderBy("file")).alias("inside")).join(firsts, "group").select("file", (F.col("group_first") + F.col("inside")).alias("first"))
    return docs.join(starts, "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write ``docs`` to shard files and return what reading them back gives."""
    spark = docs.sparkSession
    path = path or Scratch(spark, "shards").root
    write_tokens(docs, path, tokenizer, end_id)
    try:
        return read_tokens(spark, path)
    except Exception as e:  # Spark names an empty folder's pattern as a missing path
        if "PATH_NOT_FOUND" in str(e):
            return empty(spark)
        raise
