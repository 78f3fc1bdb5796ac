"""Finding documents by name: ids, paths, ends of paths, globs, near misses; and the contexts of paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import paths as P
from tarn.functions.text import line_slice

#: How far a near miss may be, how many are told, and the size beyond which a body isn't given (fixed values).
NEAR, SIMILAR, MOST_BYTES = 5, 5, 64 * 1024


def split_range(name: str) -> tuple[str, int | None, int | None]:
    """A name and the line range after it: "a.md:120" from a line on, "a.md:120:40" so many lines."""
    m = re.fullmatch(r"(.+?)(?::(\d+))?(?::(\d+))?", name, re.DOTALL)
    number = lambda x: None if x is None else max(1, int(x))
    return m[1], number(m[2]), number(m[3])


def line_range_of(name: Column) -> Column:
    """As ``split_range``, for a column: struct(name, first, count)."""
    rule = r"(?s)^(.+?)(?::(\d+))?(?::(\d+))?$"
    number = lambda k: F.greatest(F.nullif(F.regexp_extract(name, rule, k), F.lit("")).cast("int"), F.when(F.regexp_extract(name, rule, k) != "", 1))
    return F.struct(F.regexp_extract(name, rule, 1).alias("name"), number(2).alias("first"), number(3).alias("count"))


def by_docid(docs: DataFrame, given: str) -> DataFrame:
    """The first document (by collection and path) whose hash begins so; none where ``given`` is no document id."""
    digits = P.parse_docid(given)
    found = docs.where(F.col("hash").startswith(digits.lower()) if digits else F.lit(False))
    return found.orderBy("collection", "path").limit(1)


def resolve(docs: DataFrame, names: DataFrame) -> DataFrame:
    """name, status (found, ambiguous or missing), n, and the document's collection, path, hash where found.

    ``names``: name. Tried in this order, the first kind that matches anything decides: id or virtual path, collection/path, path, an end of
    a path that begins after a slash. Equi-joins throughout: a path's ends are exploded, so no name is held against every path.
    """
    bare = names.select("name", F.regexp_replace(F.trim("name"), "^tarn:/*", "").alias("key"), P.normalized_docid(F.col("name")).alias("digits"), P.is_docid(F.col("name")).alias("is_id"))
    own = docs.select("collection", "path", "hash")
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    whole = F.concat_ws("/", "collection", "path")
    keys = own.select("collection", "path", "hash", F.explode(F.array_distinct(F.concat(
        F.array(F.struct(F.lit(1).alias("tier"), whole.alias("key")), F.struct(F.lit(2).alias("tier"), F.col("path").alias("key"))),
        F.transform(ends, lambda e: F.struct(F.lit(3).alias("tier"), e.alias("key"))),
    ))).alias("k")).select("collection", "path", "hash", "k.tier", "k.key")
    named = bare.join(keys, "key").select("name", "tier", "collection", "path", "hash")
    ids = bare.where("is_id").withColumn("short", F.lower(F.substring("digits", 1, 6))).join(own.withColumn("short", F.substring("hash", 1, 6)), "short")
    ids = ids.where(F.col("hash").startswith(F.lower(F.col("digits")))).select("name", F.lit(0).alias("tier"), "collection", "path", "hash")
    # an id stands for its first document
    ids = ids.groupBy("name", "tier").agg(F.min(F.struct("collection", "path", "hash")).alias("d")).select("name", "tier", "d.*")
    every = named.unionByName(ids).distinct()
    best = every.groupBy("name", "tier").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("collection", "path", "hash")).alias("d")).groupBy("name").agg(F.min_by(F.struct("n", "d"), "tier").alias("b"))
    out = names.select("name").distinct().join(best, "name", "left")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("b.n") > 1, "ambiguous").otherwise("found")
    one = lambda c: F.when(status == "found", F.col(f"b.d.{c}")).alias(c)
    return out.select("name", status.alias("status"), F.coalesce(F.col("b.n"), F.lit(0)).alias("n"), one("collection"), one("path"), one("hash"))


def similar(docs: DataFrame, name: str, most: int = NEAR, limit: int = SIMILAR) -> DataFrame:
    """path, distance of the paths nearest to a name, whatever the case."""
    d = F.levenshtein(F.lower("path"), F.lit(name.lower()), most)
    return docs.select("path", d.alias("distance")).where("distance >= 0").orderBy("distance", "path").limit(limit)


def similar_names(docs: DataFrame, names: DataFrame, most: int = NEAR, limit: int = SIMILAR) -> DataFrame:
    """name, path, distance: for each of ``names`` (name) the nearest distinct paths, as ``similar`` finds them one by one.

    A path within ``most`` edits of a name keeps at least one of its ``most`` + 1 equal
    pieces, moved by at most ``most`` places; so paths and names meet on (length, number,
    piece), and only those that do are compared. A path sends one row a piece, a name one
    for each length, piece and place it may have (under (2 most + 1)**2 (most + 1), fewer as
    equal ones are sent once).
    """
    pieces, far = most + 1, F.sequence(F.lit(-most), F.lit(most))

    def start(length: Column, k: Column) -> Column:
        return F.floor(length * k / pieces).cast("int")

    def piece(text: Column, length: Column, k: Column, moved: Column) -> Column:
        a, b = start(length, k), start(length, k + 1)
        return F.when(a + moved >= 0, F.substring(text, a + moved + 1, b - a))

    number = F.sequence(F.lit(0), F.lit(most))
    have = docs.select("path", F.lower("path").alias("low")).distinct().withColumn("length", F.char_length("low")).withColumn("k", F.explode(number))
    have = have.select("path", "low", "length", "k", piece(F.col("low"), F.col("length"), F.col("k"), F.lit(0)).alias("piece"))
    want = names.select("name", F.lower("name").alias("asked")).distinct().withColumn("length", F.explode(F.transform(far, lambda x: F.char_length("asked") + x))).where("length >= 0")
    want = want.withColumn("k", F.explode(number)).withColumn("moved", F.explode(far))
    want = want.select("name", "asked", "length", "k", piece(F.col("asked"), F.col("length"), F.col("k"), F.col("moved")).alias("piece"))
    # a piece that the name is too short for isn't whole
    want = want.where(F.char_length("piece") == start(F.col("length"), F.col("k") + 1) - start(F.col("length"), F.col("k"))).distinct()
    close = have.join(want, ["length", "k", "piece"]).select("name", "path", F.levenshtein("low", "asked", most).alias("distance")).where("distance >= 0").distinct()
    order = F.struct("distance", "path")
    return close.groupBy("name").agg(F.slice(F.sort_array(F.collect_list(order)), 1, limit).alias("d")).select("name", F.explode("d").alias("d")).select("name", "d.path", "d.distance")



def by_globs(docs: DataFrame, mask: str) -> DataFrame:
    """Documents whose virtual path, path, or collection/path matches any glob of the mask."""
    globs = P.split_globs(mask)
    match = P.matches_globs(F.col("path"), globs) | P.matches_globs(F.concat_ws("/", "collection", "path"), globs)
    virtual = [g.removeprefix(P.SCHEME) for g in globs if g.startswith(P.SCHEME)]
    if virtual:
        match = match | P.matches_globs(F.concat_ws("/", "collection", "path"), virtual)
    return docs.where(match)


def ignored(path: Column, globs: list[str]) -> Column:
    """The first ignore rule that hides a path, hidden files included; null where none does."""
    return F.coalesce(*(F.when(path.rlike(P.glob_regex(g, dots=True)), F.lit(g)) for g in globs), F.lit(None).cast("string"))


def with_bodies(found: DataFrame, content: DataFrame, most_bytes: int = MOST_BYTES, first: int | None = None, count: int | None = None) -> DataFrame:
    """Bodies (a range of lines) of documents; those beyond the size are marked as skipped, with the reason."""
    got = found.join(content.select("hash", "doc"), "hash")
    large = F.length("doc") > most_bytes
    reason = F.concat(F.lit("File too large ("), F.round(F.length("doc") / 1024).cast("long").cast("string"), F.lit("KB)"))
    return got.select(*found.columns, F.when(~large, line_slice(F.col("doc"), first, count)).alias("body"), large.alias("skipped"), F.when(large, reason).alias("skip_reason"))


def contexts(docs: DataFrame, prefixes: DataFrame, overall: str | None = None) -> DataFrame:
    """The documents with ``context``: the overall one, then those of all prefixes of the path, the most general first.

    ``prefixes``: collection, prefix, context. A path's prefixes by characters are looked up by an equi-join on the lengths that occur in its
    collection, which are few.
    """
    slash = lambda c: F.when(c.startswith("/"), c).otherwise(F.concat(F.lit("/"), c))
    rules = prefixes.select("collection", slash(F.col("prefix")).alias("prefix"), "context")
    sizes = rules.groupBy("collection").agg(F.collect_set(F.length("prefix")).alias("sizes"))
    each = docs.select("collection", "path").distinct().join(sizes, "collection")
    each = each.withColumn("size", F.explode("sizes")).withColumn("prefix", slash(F.col("path")).substr(F.lit(1), F.col("size"))).where(F.length("prefix") == F.col("size"))
    found = each.join(rules, ["collection", "prefix"]).groupBy("collection", "path").agg(F.array_sort(F.collect_list(F.struct("size", "prefix", "context"))).alias("c"))
    own = docs.join(found, ["collection", "path"], "left")
    texts = F.transform(F.coalesce("c", F.array().cast("array<struct<size:int,prefix:string,context:string>>")), lambda x: x["context"])
    every = F.concat(F.array(F.lit(overall)), texts) if overall else texts
    return own.withColumn("context", F.when(F.size(every) > 0, F.array_join(every, "\n\n"))).select(*docs.columns, "context")


def collection_of(path: Column, roots: list[tuple[str, str]]) -> Column:
    """The collection whose root is the longest that a path is below."""
    out = F.lit(None).cast("string")
    for name, root in sorted(roots, key=lambda r: len(r[1])):
        out = F.when((path == root) | path.startswith(root.rstrip("/") + "/"), F.lit(name)).otherwise(out)
    return out


def listing(docs: DataFrame, content: DataFrame, collection: str, prefix: str = "") -> DataFrame:
    """path, size, modified_at of a collection's documents below a prefix."""
    some = docs.where((F.col("collection") == collection) & F.col("path").startswith(prefix))
    return some.join(content.select("hash", F.octet_length("doc").alias("size")), "hash").select("path", "size", "modified_at").orderBy("path")


def first_of_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
