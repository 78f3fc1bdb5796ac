"""Exact dedup over a persistent digest index.

The index is a log of keepers, bucketed and sorted by the SHA-256 of the
normalised text. A batch of documents is first reduced to one row a digest
(partial aggregation keeps a group of any size to one row for each map task),
then set against the log by a sort-merge anti-join that reads it in its
bucketing; what is new, or better than what the log has, is appended. How many
rows of the batch had a text that the log knows goes to a second table in the
same bucketing, so that group sizes stay right over any number of batches. The
number of buckets is kept beside the data and a different one is refused.

Normalised text: every character of ``[\\x20\\x09-\\x0D]`` deleted; null counts as
empty; a very long text is hashed whole. Of equal texts, over all batches, the row
with the most code points in the original text stays, then the smallest doc_id,
nulls last; ``first=True`` lets a keeper of an earlier batch stay whatever comes
later. Two writers at a time can both append a digest: readers take the best row,
so nothing is told twice. An empty table gives an empty result and an empty index;
repeated rows count as members of their group; extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.shared import Scratch, input_bytes

#: Characters that do not count: space and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
#: One bucket of a new index for so many bytes of digests (some 45 a row), and the most that it gets: Spark takes no more than 100,000.
BUCKET_BYTES, MOST_BUCKETS = 1 << 20, 1 << 16


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes), n_chars of the original text."""
    text = F.coalesce(F.col("`text`"), F.lit(""))
    bare = F.translate(text, WHITE, "")
    return docs.select(F.col("`doc_id`").alias("doc_id"), F.unhex(F.sha2(bare, 256)).alias("digest"), F.char_length(text).alias("n_chars"))


class DigestIndex:
    """The persistent index at ``location`` (a folder that every executor reaches). ``buckets`` may be left out where the index exists."""

    keepers = "digest binary, keep_id long, n_chars long, group_size long, batch long"
    repeats = "digest binary, n long"

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None, first: bool = False):
        self.spark, self.location, self.first = spark, location.rstrip("/"), first
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.location).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = self._agreed(buckets)
        self.names = {}
        for kind in ("keepers", "repeats"):
            self._fs.mkdirs(self._fs_path(f"{self.location}/{kind}"))
            self.names[kind] = f"tarn_{kind}_{uuid.uuid4().hex[:12]}"
            spark.sql(f"CREATE TABLE {self.names[kind]} ({getattr(self, kind)}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}/{kind}'")

    def _agreed(self, asked: int | None) -> int:
        """The number of buckets kept beside the data; written by the first to open the index."""
        at = self._fs_path(f"{self.location}/BUCKETS")
        if self._fs.exists(at):
            known = int(self.spark.read.text(at.toString()).first()[0])
            if asked not in (None, known):
                raise ValueError(f"the index at {self.location} has {known} buckets, not {asked}")
            return known
        if asked is None:
            raise ValueError(f"no index at {self.location}: say how many buckets it is to have")
        out = self._fs.create(at, False)
        out.write(bytearray(str(asked).encode()))
        out.close()
        return asked

    def frame(self, kind: str = "keepers") -> DataFrame:
        """The log of keepers, or the counts of repeats, in their bucketing."""
        return self.spark.table(self.names[kind])

    def add(self, rows: DataFrame) -> None:
        """Append what ``digests`` gives for a batch of documents: a row for each digest that the log lacks, or has a worse keeper of; a count for the others."""
        batch = self.frame().agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]
        best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d")))
        groups = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        groups = groups.select("digest", F.col("best.d").alias("keep_id"), (-F.col("best.n")).alias("n_chars"), "group_size", F.lit(batch).cast("long").alias("batch"))
        held = self.frame().select(F.col("digest").alias("known"), F.col("keep_id").alias("known_id"), F.col("n_chars").alias("known_chars"))
        known = F.col("digest") == F.col("known")
        if not self.first:
            id_fits = F.col("keep_id").isNull() | (F.col("known_id") <= F.col("keep_id"))
            known &= (F.col("known_chars") > F.col("n_chars")) | ((F.col("known_chars") == F.col("n_chars")) & F.coalesce(id_fits, F.lit(False)))
        new = groups.join(held.hint("merge"), known, "left_anti")
        more = groups.join(held.hint("merge"), known, "left_semi").select("digest", F.col("group_size").alias("n"))
        self._append("repeats", more)
        self._append("keepers", new)

    def _append(self, kind: str, rows: DataFrame) -> None:
        w = rows.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        w.mode("append").option("path", f"{self.location}/{kind}").saveAsTable(self.names[kind])

    def groups(self) -> DataFrame:
        """digest, keep_id, group_size of every known text, without a shuffle."""
        rank = [F.col("batch")] if self.first else []
        best = F.min(F.struct(*rank, (-F.col("n_chars")).alias("n"), F.col("keep_id").isNull().alias("z"), F.col("keep_id").alias("d")))
        keepers = self.frame().groupBy("digest").agg(best.alias("best"), F.sum("group_size").alias("n"))
        again = self.frame("repeats").groupBy("digest").agg(F.sum("n").alias("more"))
        return keepers.join(again.hint("merge"), "digest", "left").select("digest", F.col("best.d").alias("keep_id"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("group_size"))

    def close(self) -> None:
        """Forget the catalogue entries; the files stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 1) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``, put into ``index`` in so many ``batches`` (by a hash of doc_id).

    keep_id and group_size are over all that the index knows after the last batch. The caller's index stays open.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "digests")
    rows = scratch.table(digests(docs), "rows")
    own = None if index else DigestIndex(spark, scratch.path("index"), min(MOST_BUCKETS, max(4, input_bytes(rows) // BUCKET_BYTES)))
    index = index or own
    for k in range(batches):
        index.add(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    groups = scratch.table(index.groups(), "groups")  # as a plain table: Spark may split the join where one digest has a third of the rows
    if own:
        own.close()
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
