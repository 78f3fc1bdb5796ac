"""The state of an index: changes against a scan, pending embeddings, orphans, status and clean-up.

All of these are frames in, frames out; ``tarn.sources.snapshots`` stores them.
documents: collection, path, title, hash, created_at, modified_at, active.
content: hash, doc, created_at. chunks: hash, seq, pos, model, fingerprint,
total_chunks, embedded_at. vectors: hash, seq, embedding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import days_since


def content_table(docs: DataFrame) -> DataFrame:
    """hash, doc, n_docs: each distinct body once."""
    return docs.groupBy("hash").agg(F.first("doc").alias("doc"), F.count(F.lit(1)).alias("n_docs"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """collection, path, change of every path of either: added, updated, retitled, reactivated, unchanged, removed or gone (inactive before and after)."""
    a = old.select("collection", "path", F.col("hash").alias("h0"), F.col("title").alias("t0"), F.col("active").alias("a0"))
    b = new.select("collection", "path", F.col("hash").alias("h1"), F.col("title").alias("t1"))
    was, now = F.col("h0").isNotNull(), F.col("h1").isNotNull()
    kind = (
        F.when(now & ~was, "added")
        .when(now & ~F.col("a0"), "reactivated")
        .when(now & (F.col("h0") != F.col("h1")), "updated")
        .when(now & ~F.col("t0").eqNullSafe(F.col("t1")), "retitled")
        .when(now, "unchanged")
        .when(F.col("a0"), "removed")
        .otherwise("gone")
    )
    return a.join(b, ["collection", "path"], "full_outer").select("collection", "path", kind.alias("change"))


def refreshed(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The documents after a scan of the collections in ``new``: upserted on (collection, path), unseen ones inactive, other collections as they were."""
    scanned = new.select("collection").distinct().withColumn("scanned", F.lit(True))
    a = old.select("collection", "path", *(F.col(c).alias(f"o_{c}") for c in ("title", "hash", "created_at", "modified_at", "active")))
    b = new.select("collection", "path", F.col("title").alias("n_title"), F.col("hash").alias("n_hash"))
    both = a.join(b, ["collection", "path"], "full_outer").join(F.broadcast(scanned), "collection", "left")  # a row a collection
    seen, same = F.col("n_hash").isNotNull(), F.col("n_hash").eqNullSafe(F.col("o_hash")) & F.col("n_title").eqNullSafe(F.col("o_title"))
    return both.select(
        "collection", "path", F.coalesce("n_title", "o_title").alias("title"), F.coalesce("n_hash", "o_hash").alias("hash"),
        F.coalesce("o_created_at", now).alias("created_at"), F.when(seen & ~same, now).otherwise(F.coalesce("o_modified_at", now)).alias("modified_at"),
        F.when(seen, True).when(F.col("scanned"), False).otherwise(F.col("o_active")).alias("active"),
    )


def change_counts(changed: DataFrame) -> DataFrame:
    """One row: indexed, updated, unchanged, removed."""
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return changed.agg(n("added", "reactivated").alias("indexed"), n("updated", "retitled").alias("updated"), n("unchanged").alias("unchanged"), n("removed").alias("removed"))


def active(docs: DataFrame) -> DataFrame:
    return docs.where("active")


def orphaned_content(content: DataFrame, docs: DataFrame) -> DataFrame:
    """Bodies that no document has, inactive ones included."""
    return content.join(docs.select("hash").distinct(), "hash", "left_anti")


def orphaned_vectors(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks of bodies that no active document has."""
    return chunks.join(active(docs).select("hash").distinct(), "hash", "left_anti")


def _complete(chunks: DataFrame, model: str, fingerprint: str) -> DataFrame:
    own = chunks.where((F.col("model") == model) & (F.col("fingerprint") == fingerprint))
    return own.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("total_chunks").alias("total")).where("n >= total").select("hash")


def pending(docs: DataFrame, content: DataFrame, chunks: DataFrame, model: str, fingerprint: str) -> DataFrame:
    """hash, path (the first of its documents), n_bytes of active bodies without a full set of chunks of this model, in path order."""
    some = active(docs).groupBy("hash").agg(F.min("path").alias("path"))
    some = some.join(_complete(chunks, model, fingerprint), "hash", "left_anti")
    return some.join(content.select("hash", F.octet_length("doc").cast("long").alias("n_bytes")), "hash").orderBy("path", "hash")


def incomplete(chunks: DataFrame) -> DataFrame:
    """Bodies with fewer chunks than they should have."""
    return chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("total_chunks").alias("total")).where("n < total")


def exclusive_hashes(docs: DataFrame, collection: str) -> DataFrame:
    """Bodies whose active documents are all in one collection."""
    return active(docs).groupBy("hash").agg(F.min("collection").alias("lo"), F.max("collection").alias("hi")).where((F.col("lo") == collection) & (F.col("hi") == collection)).select("hash")


def without_embeddings(chunks: DataFrame, docs: DataFrame, collection: str | None = None) -> DataFrame:
    """The chunks left when all embeddings are cleared, or those of bodies that only one collection has."""
    return chunks.where(F.lit(False)) if collection is None else chunks.join(exclusive_hashes(docs, collection), "hash", "left_anti")


def fingerprint_census(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("model", "fingerprint").agg(F.count_distinct("hash").alias("n_hashes"), F.count(F.lit(1)).alias("n_chunks"))


def batches(rows: DataFrame, most_docs: int = 64, most_bytes: int = 64 << 20) -> DataFrame:
    """Pending bodies with a batch number: a greedy fill by count and bytes inside each partition, in the order of rows."""
    positive("most_docs", most_docs), positive("most_bytes", most_bytes)
    ddl = "hash string, path string, n_bytes long, partition int, batch int"

    def run(frames):
        import pandas as pd
        from pyspark import TaskContext

        part, k, n, size = TaskContext.get().partitionId(), 0, 0, 0
        for pdf in frames:
            numbers = []
            for b in pdf["n_bytes"]:
                if n and (n >= most_docs or size + b > most_bytes):
                    k, n, size = k + 1, 0, 0
                n, size = n + 1, size + int(b)
                numbers.append(k)
            yield pd.DataFrame({"hash": pdf["hash"], "path": pdf["path"], "n_bytes": pdf["n_bytes"], "partition": part, "batch": numbers})

    return rows.select("hash", "path", "n_bytes").mapInPandas(run, ddl)


def collections_listing(collections: DataFrame, docs: DataFrame) -> DataFrame:
    """name, n_docs, n_active, last_modified of every collection, empty ones included."""
    stats = docs.groupBy(F.col("collection").alias("name")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("active").alias("n_active"), F.max("modified_at").alias("last_modified"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return collections.select("name").join(stats, "name", "left").select("name", zero("n_docs"), zero("n_active"), "last_modified")


def status(docs: DataFrame) -> DataFrame:
    """collection, n_active, last_modified, the latest first."""
    return active(docs).groupBy("collection").agg(F.count(F.lit(1)).alias("n_active"), F.max("modified_at").alias("last_modified")).orderBy(F.desc("last_modified"), "collection")


def health(docs: DataFrame, needs_embedding: DataFrame, now: Column) -> DataFrame:
    """One row: total_docs, needs_embedding, days_stale."""
    total = active(docs).agg(F.count(F.lit(1)).alias("total_docs"), days_since(F.max("modified_at"), now).alias("days_stale"))
    return total.crossJoin(needs_embedding.agg(F.count_distinct("hash").alias("needs_embedding"))).select("total_docs", "needs_embedding", "days_stale")  # one row each


def cleanup_preview(docs: DataFrame, content: DataFrame, chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: what a clean-up would take."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one(docs.where("NOT active"), "inactive_documents")
    for df, name in ((orphaned_content(content, docs), "orphaned_content"), (orphaned_vectors(chunks, docs), "orphaned_vectors"), (cache, "cached_responses")):
        out = out.crossJoin(one(df, name))  # one row each
    return out


def newest(cache: DataFrame, keep: int = 1000) -> DataFrame:
    """The cache entries that eviction keeps."""
    return cache.orderBy(F.desc("created_at"), "cache_key").limit(keep)


def page(docs: DataFrame, key: str, after: int, most: int = 500) -> DataFrame:
    """The next page of active documents in the order of ``key``, from the last key of the page before: a filter that reaches the scan and a top-k, whatever lies before it."""
    return active(docs).where(F.col(key) > after).orderBy(key).limit(positive("most", most))


def positive(name: str, value: int) -> int:
    """The value of an option that must be a whole number from 1."""
    if not isinstance(value, int) or isinstance(value, bool) or value < 1:
        raise ValueError(f"{name} must be a positive integer")
    return value


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def without_contexts(collections: DataFrame, docs: DataFrame) -> DataFrame:
    """Collections that have no context: name, n_docs."""
    bare = collections.where(F.coalesce(F.size("context"), F.lit(0)) <= 0).select("name")
    n = active(docs).groupBy(F.col("collection").alias("name")).agg(F.count(F.lit(1)).alias("n_docs"))
    return bare.join(n, "name", "left").select("name", F.coalesce("n_docs", F.lit(0)).alias("n_docs")).orderBy("name")


def top_folders(docs: DataFrame, collection: str, covered: list[str] = ()) -> DataFrame:
    """First folders of a collection's paths that no context's prefix covers."""
    some = active(docs).where((F.col("collection") == collection) & F.col("path").contains("/"))
    top = some.select(F.split("path", "/")[0].alias("folder")).distinct()
    clean = [p.strip("/") for p in covered]
    return (top.where(~F.col("folder").isin(clean)) if clean else top).orderBy("folder")


def adopted_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """collection, old_path, path: active rows stored under a slug whose file is now known by its literal path.

    Several literal paths can have one slug, so a row is adopted only where no live file has the slug itself as its path and the literal path
    isn't stored yet; of several literal paths the first is taken.
    """
    from tarn.functions.paths import slug

    live = new.select("collection", "path")
    unknown = live.join(active(old).select("collection", "path"), ["collection", "path"], "left_anti")
    slugged = unknown.withColumn("old_path", slug(F.col("path"))).where("old_path IS NOT NULL AND old_path != path")
    stale = active(old).select("collection", F.col("path").alias("old_path")).join(live.withColumnRenamed("path", "old_path"), ["collection", "old_path"], "left_anti")
    return slugged.join(stale, ["collection", "old_path"]).groupBy("collection", "old_path").agg(F.min("path").alias("path"))


def with_adopted_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """The documents before a refresh, adopted rows under their literal paths."""
    found = adopted_paths(old, new).withColumnRenamed("path", "new_path")
    both = old.join(found, (old["collection"] == found["collection"]) & (old["path"] == found["old_path"]) & old["active"], "left")
    return both.select(*(F.coalesce(found["new_path"], old["path"]).alias("path") if c == "path" else old[c] for c in old.columns))
