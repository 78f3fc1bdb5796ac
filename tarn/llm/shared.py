"""What the operators of this subpackage share: scratch tables in the cluster's
shared folder, code shipping, and byte-bounded batches of documents.

Scratch tables are written with Spark's commit protocol below
``spark.checkpoint.dir``; a lost executor costs the tasks it was running and
nothing that an earlier step has written.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents are worked on in units of about this many bytes of text.
UNIT_BYTES = 4 << 20
#: And of so many documents at most.
UNIT_ROWS = 50_000

#: Bytes of a batch that is sent to Python: the setting, what Spark has if it isn't set, and what is set here (executors hold a batch several times over).
ARROW, ARROW_DEFAULT, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"

_SHIPPED: set[str] = set()
#: Folders of applications without a setting.
_OWN_DIRS: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; bound the Arrow batches of the session where it doesn't say otherwise."""
    sc = spark.sparkContext
    if spark.conf.get(ARROW) == ARROW_DEFAULT:
        spark.conf.set(ARROW, ARROW_BYTES)
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="tarn-"), "tarn_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent).as_posix())
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset: on one machine a fresh temporary one, on a cluster a folder in the warehouse, unless that is on a machine's own disk, which is refused."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        if sc.applicationId not in _OWN_DIRS:
            _OWN_DIRS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tarn-shared-")
        return _OWN_DIRS[sc.applicationId]
    return _reached_by_all(spark, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tarn-scratch")


def _reached_by_all(spark: SparkSession, folder: str) -> str:
    """``folder``, if it isn't on a machine's own disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        raise ValueError(f"spark.checkpoint.dir is unset and {folder} is on each machine's own disk: name a folder there that all executors share")
    return folder


class Scratch:
    """A folder of intermediate tables of one operator call.

    ``table`` writes a frame and reads it back, which runs it once and cuts its
    lineage; ``drop`` removes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tarn-{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, partition_by: str | None = None, codec: str = "zstd") -> DataFrame:
        w = df.write.option("compression", codec)
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(self.path(name))
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(n))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame (the files' size for a scan); where it has none, the texts' bytes, counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = int(df.agg(F.coalesce(F.sum(F.octet_length(F.col("`text`"))), F.lit(0))).first()[0])
    return size


def trim() -> None:
    """Give freed memory back to the system (a worker that waits for its next task would hold it beside the others)."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if give:
        give(0)


def rows_of(batches: Iterator[pa.RecordBatch], at_once: int = 64) -> Iterator[dict]:
    """The rows of batches, a few of them in Python at a time."""
    for b in batches:
        for a in range(0, b.num_rows, at_once):
            yield from b.slice(a, at_once).to_pylist()
    trim()


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name can't clash; dealt out to all cores where the scan has fewer splits than there are cores (a file of one row group is one split)."""
    found = docs.select(*(F.col(f"`{n}`") for n in names))
    cores, planned = docs.sparkSession.sparkContext.defaultParallelism, found._jdf.queryExecution()
    scans = "Adaptive" not in planned.executedPlan().nodeName()  # no shuffle before it, so asking runs nothing
    return found.repartition(cores) if scans and planned.toRdd().getNumPartitions() < cores else found


def parts(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = UNIT_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts as UTF-8 bytes; null is empty) in units of about ``limit`` bytes, whole documents always."""
    for b in batches:
        if not b.num_rows:
            continue
        at_text = b.schema.get_field_index(text)
        col = b.column(at_text)
        lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        at = size = 0
        for i, n in enumerate(lengths):
            size += int(n)
            if size >= limit or i + 1 - at >= UNIT_ROWS or i + 1 == len(lengths):
                part = b.slice(at, i + 1 - at)
                yield part, [t or b"" for t in part.column(at_text).cast(_binary(col.type)).to_pylist()]
                at, size = i + 1, 0
    trim()


def units(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = UNIT_BYTES) -> Iterator[tuple[dict, list[bytes]]]:
    """As ``parts``, the other columns as lists by name."""
    for part, texts in parts(batches, text, limit):
        yield {f.name: part.column(k).to_pylist() for k, f in enumerate(part.schema) if f.name != text}, texts


def filter_units(docs: DataFrame, keep: Callable[[list[bytes]], list], limit: int = UNIT_BYTES) -> DataFrame:
    """The rows of ``docs`` for whose texts ``keep`` is true, all columns as they are."""
    ship(docs.sparkSession)

    def run(batches):
        for part, texts in parts(batches, limit=limit):
            yield part.filter(pa.array([bool(x) for x in keep(texts)]))

    return docs.mapInArrow(run, docs.schema)


def _binary(kind: pa.DataType) -> pa.DataType:
    return pa.large_binary() if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) else pa.binary()


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a simple DDL string."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def map_units(docs: DataFrame, ddl: str, work: Callable[[dict, list[bytes]], dict], limit: int = UNIT_BYTES) -> DataFrame:
    """Apply ``work`` to units of documents. A frame with a ``text`` column in, the columns of ``ddl`` out."""
    ship(docs.sparkSession)
    schema = arrow_schema(ddl)

    def run(batches):
        for rest, texts in units(batches, limit=limit):
            yield batch(schema, work(rest, texts))

    return docs.mapInArrow(run, ddl)
