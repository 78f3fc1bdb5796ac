"""An index on disk: tables in numbered versions, and a pointer that names the current ones.

Pointers are numbered files and the highest number counts. A commit writes new
versions of tables beside the old, then the next pointer, whose file is created
exclusively: two commits at a time can't get one number, and the later one fails and
may be tried again. A pointer that isn't wholly written yet doesn't count, so a reader
sees all of a commit or nothing of it, at no moment is there no pointer, and no table
is overwritten while a plan reads it. Who reads several tables does so through
``pinned``, which looks the pointer up once.

A keyword index' segments are folders that the pointer lists: a commit adds one, or
puts one in the place of several.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tarn.operators import segments as S

#: A pointer that stays unfinished for so many seconds is what a writer that died has left.
UNFINISHED_S = 60
#: Tables and their columns.
SCHEMAS = {
    "documents": "collection string, path string, title string, hash string, created_at timestamp, modified_at timestamp, active boolean",
    "content": "hash string, doc string, created_at timestamp",
    "chunks": "hash string, seq int, pos int, model string, fingerprint string, total_chunks int, embedded_at timestamp",
    "vectors": "hash string, seq int, embedding array<float>",
    "cache": "cache_key string, result string, created_at timestamp",
    "collections": "name string, path string, pattern string, ignore array<string>, include_by_default boolean, update_command string, context map<string,string>",
    "config": "key string, value string",
}
#: The table whose rows a reader picks by a key, and the key: sorted, so that row groups' statistics skip the rest.
SORTED = {"content": "hash", "chunks": "hash", "vectors": "hash"}


class Warehouse:
    """Versioned tables below ``root`` (any file system that Spark reaches)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._session = spark, root.rstrip("/"), uuid.uuid4().hex[:12]
        self._pin: tuple[int, dict] | None = None
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        at = self._path(f"{self.root}/pointers")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _current(self) -> tuple[int, dict]:
        """The number of the last finished commit (0: none), and the tables' versions."""
        if self._pin:
            return self._pin
        for number in reversed(self._pointers()):
            found = self._content(number)
            if found is not None:
                return number, found
        return 0, {}

    def _content(self, number: int) -> dict | None:
        """What a pointer says; None if it isn't wholly written."""
        source = self._fs.open(self._path(f"{self.root}/pointers/{number}"))
        try:
            return json.loads(bytes(source.readAllBytes()))
        except ValueError:
            return None
        finally:
            source.close()

    def pinned(self) -> Warehouse:
        """A reader of one and the same commit, whatever is committed meanwhile."""
        w = Warehouse(self.spark, self.root)
        w._pin = self._current()
        return w

    def exists(self) -> bool:
        """Whether anything was committed."""
        return self._current()[0] > 0

    def read(self, table: str) -> DataFrame:
        version = self._current()[1].get(table)
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{table}/{version}")

    def segments(self) -> list[list]:
        """[number, version, bytes] of the keyword index' segments, in order."""
        return self._current()[1].get("segments", [])

    def read_segments(self, only: list[list] | None = None) -> dict[str, DataFrame]:
        """The segments' tables."""
        known = self.segments() if only is None else only
        empty = lambda t: self.spark.createDataFrame([], S.SCHEMAS[t])
        return {t: self.spark.read.schema(S.SCHEMAS[t]).parquet(*(f"{self.root}/{t}/{v}" for _, v, _ in known)) if known else empty(t) for t in S.SCHEMAS}

    def keyword_index(self) -> S.Segmented:
        t = self.read_segments()
        return S.Segmented(t["postings"], t["dictionary"], t["totals"], t["marks"] if len(self.segments()) > 1 else None)

    def write_segment(self, number: int, frames: dict[str, DataFrame]) -> list:
        """Write a segment's tables, beside all others; the entry by which a commit takes it in. Without a dictionary it is made of the written postings and what went."""
        version, at = uuid.uuid4().hex[:12], {t: f"{self.root}/{t}/" for t in S.SCHEMAS}
        columns = lambda t: [f.split()[0] for f in S.SCHEMAS[t].split(", ")]
        frames["postings"].select(*columns("postings")).write.parquet(at["postings"] + version)
        written = self.spark.read.schema(S.SCHEMAS["postings"]).parquet(at["postings"] + version)
        words = frames.get("dictionary")
        words = S.dictionary(written, frames["less"], number) if words is None else words
        words.select(*columns("dictionary")).sortWithinPartitions("term").write.parquet(at["dictionary"] + version)
        frames["totals"].select(*columns("totals")).coalesce(1).write.parquet(at["totals"] + version)
        frames["marks"].select(*columns("marks")).write.parquet(at["marks"] + version)
        return [number, version, int(self._fs.getContentSummary(self._path(at["postings"] + version)).getLength())]

    def staged(self, df: DataFrame) -> DataFrame:
        """``df`` computed once, into files beside the tables that no reader of the index looks at."""
        at = f"{self.root}/staged/{self._session}/{uuid.uuid4().hex[:12]}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop_staged(self) -> None:
        self._fs.delete(self._path(f"{self.root}/staged/{self._session}"), True)

    def commit(self, segments: list[list] | None = None, **tables: DataFrame) -> None:
        """New versions of some tables, and another list of segments, all at once."""
        number, now = self._current()
        now = dict(now)
        for name, df in tables.items():
            version = uuid.uuid4().hex[:12]
            columns = [f.split()[0] for f in SCHEMAS[name].replace("map<string,string>", "m").split(", ")]
            writer = df.select(*columns)
            if name in SORTED:
                writer = writer.repartitionByRange(SORTED[name]).sortWithinPartitions(SORTED[name])
            writer.write.parquet(f"{self.root}/{name}/{version}")
            now[name] = version
        if segments is not None:
            now["segments"] = segments
        self._publish(number + 1, now)

    def _publish(self, number: int, now: dict) -> None:
        target = self._path(f"{self.root}/pointers/{number}")
        taken = RuntimeError(f"commit {number} of {self.root} was made by another writer")
        while self._fs.exists(target):  # finished: too late; unfinished and old: the writer died, its number is passed over
            if self._content(number) is not None or time.time() - self._fs.getFileStatus(target).getModificationTime() / 1000 < UNFINISHED_S:
                raise taken
            number += 1
            target = self._path(f"{self.root}/pointers/{number}")
        try:
            out = self._fs.create(target, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e):
                raise taken from None
            raise
        out.write(bytearray(json.dumps(now).encode()))
        out.close()

    def vacuum(self) -> int:
        """Delete versions of tables that the last pointer doesn't name, and older pointers; how many versions went."""
        (number, now), gone = self._current(), 0
        for name in SCHEMAS:
            folder = self._path(f"{self.root}/{name}")
            if self._fs.exists(folder):
                for s in self._fs.listStatus(folder):
                    if s.getPath().getName() != now.get(name):
                        self._fs.delete(s.getPath(), True)
                        gone += 1
        for name in S.SCHEMAS:
            folder, kept = self._path(f"{self.root}/{name}"), {v for _, v, _ in now.get("segments", [])}
            if self._fs.exists(folder):
                for s in self._fs.listStatus(folder):
                    if s.getPath().getName() not in kept:
                        self._fs.delete(s.getPath(), True)
                        gone += 1
        for k in self._pointers():
            if k < number:
                self._fs.delete(self._path(f"{self.root}/pointers/{k}"), False)
        return gone
