"""Scans of text files, and the configurations and example files beside them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import paths as P
from tarn.functions.text import title

#: What a collection takes where it says nothing (fixed value).
PATTERN = "**/*.md"


#: So many moments of change are asked for one by one; of more, all after the first.
MOMENTS = 200


def _matching(spark: SparkSession, root: str, mask: str, ignore: list[str] | None) -> DataFrame:
    """at (path below the root), modificationTime, length, content of a folder's files that match. What isn't selected of them isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    bare = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    found = files.withColumn("at", F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))).where(F.col("at").startswith(base))
    found = found.withColumn("at", F.col("at").substr(F.lit(len(base) + 1), F.length("at")))
    found = found.where(P.matches_globs(F.col("at"), P.split_globs(mask)) & ~P.excluded(F.col("at")))
    return found.where(~P.matches_globs(F.col("at"), ignore, dots=True)) if ignore else found


def listing(spark: SparkSession, root: str, mask: str = PATTERN, ignore: list[str] | None = None) -> DataFrame:
    """path (below root), modified_at, length of the files that ``scan`` would look at; none is opened."""
    return _matching(spark, root, mask, ignore).select(F.col("at").alias("path"), F.col("modificationTime").alias("modified_at"), "length")


def scan(spark: SparkSession, root: str, mask: str = PATTERN, ignore: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """path (below root), title, hash, doc, modified_at of a folder's files that match; blank ones don't count.

    Files outside the root (by links) and in excluded folders are left out. Spark lists and reads them in parallel; unreadable ones are
    skipped. With ``only`` (path, modified_at, as listed) just these files: by their moments of change, which Spark tests before it opens
    a file, and later ones, for files that have changed again since.
    """
    found = _matching(spark, root, mask, ignore)
    if only is not None:
        moments = [r[0] for r in only.select("modified_at").distinct().limit(MOMENTS + 1).collect()]
        first, last = only.agg(F.min("modified_at"), F.max("modified_at")).first()
        then, one_by_one = F.col("modificationTime"), F.lit(False)
        for m in moments:
            one_by_one |= then == F.lit(m)
        found = found.where(F.lit(False) if first is None else then >= F.lit(first) if len(moments) > MOMENTS else one_by_one | (then > F.lit(last)))
        found = found.join(only.select(F.col("path").alias("at")).distinct(), "at", "left_semi")
    text = found.select(F.col("at").alias("path"), F.decode("content", "UTF-8").alias("doc"), F.col("modificationTime").alias("modified_at"))
    text = text.where(F.trim(F.regexp_replace("doc", r"\s+", " ")) != "")
    return text.select("path", title(F.col("doc"), F.col("path")).alias("title"), P.content_hash(F.col("doc")).alias("hash"), "doc", "modified_at")


def load_config(path: str) -> dict:
    """A YAML (or JSON) configuration: collections, global_context, models. A missing one is empty."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError:
        return {"collections": {}}
    try:
        import yaml

        found = yaml.safe_load(text)
    except ImportError:
        found = json.loads(text)
    found = found or {}
    found.setdefault("collections", {})
    return found


def save_config(path: str, config: dict) -> None:
    try:
        import yaml

        text = yaml.safe_dump(config, sort_keys=False, allow_unicode=True)
    except ImportError:
        text = json.dumps(config, indent=2, ensure_ascii=False)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def collections_frame(spark: SparkSession, config: dict) -> DataFrame:
    """A configuration's collections as a table."""
    rows = [
        (name, c.get("path"), c.get("pattern", PATTERN), list(c.get("ignore") or []), bool(c.get("includeByDefault", True)), c.get("update"), dict(c.get("context") or {}))
        for name, c in config.get("collections", {}).items()
    ]
    from tarn.sources.snapshots import SCHEMAS

    return spark.createDataFrame(rows, SCHEMAS["collections"])


class ExampleError(ValueError):
    """A line of an example file that isn't a valid example."""


def load_examples(spark: SparkSession, path: str) -> DataFrame:
    """query, output (array of type and text), category, intent, is_short of a JSON Lines file; a bad line fails the load, with its text."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    schema = "query string, output array<array<string>>, category string, intent string, is_short boolean"
    rows = raw.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("x"))
    bad_pair = F.exists("x.output", lambda p: (F.size(p) != 2) | ~p[0].isin("lex", "vec", "hyde") | (F.trim(p[1]) == "") | p[1].isNull())
    bad = F.col("x").isNull() | F.col("x.query").isNull() | (F.trim("x.query") == "") | F.col("x.output").isNull() | (F.size("x.output") == 0) | bad_pair
    odd = rows.where(F.coalesce(bad, F.lit(True))).limit(1).collect()
    if odd:
        raise ExampleError(f"not an example: {odd[0]['value'][:200]}")
    pairs = F.transform("x.output", lambda p: F.struct(p[0].alias("type"), p[1].alias("text")))
    return rows.select("x.query", pairs.alias("output"), "x.category", "x.intent", "x.is_short")


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """query, searches (array of type and query) of a JSON Lines file in either shape: structured, or chat messages whose last answer is the output."""
    schema = "query string, searches array<struct<type:string,query:string,value:string>>, messages array<struct<role:string,content:string>>"
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("x"))
    said = lambda role: F.element_at(F.filter("x.messages", lambda m: m["role"] == role), -1)["content"]
    asked = F.trim(F.element_at(F.split(said("user"), "Expand this search query:"), -1))
    structured = F.transform("x.searches", lambda s: F.struct(s["type"].alias("type"), F.coalesce(F.nullif(s["query"], F.lit("")), s["value"]).alias("query")))
    return rows.select(F.coalesce("x.query", asked).alias("query"), F.coalesce(structured, typed_lines(said("assistant"))).alias("searches")).where("query IS NOT NULL AND searches IS NOT NULL")


def typed_lines(text: Column) -> Column:
    """Lines "type: text" of an output as an array of type and query; others are dropped."""
    bare = F.regexp_replace(F.replace(text, F.lit("<|im_end|>"), F.lit("")), r"(?s)<think>.*?</think>", "")
    rows = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^(lex|vec|hyde):"))
    return F.transform(rows, lambda x: F.struct(F.regexp_extract(x, "^([a-z]+):", 1).alias("type"), F.trim(F.regexp_replace(x, "^[a-z]+:", "")).alias("query")))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores, where a scan has fewer splits than there are cores (a file of one row group is one split); as it is otherwise."""
    cores, planned = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    scans = "Adaptive" not in planned.executedPlan().nodeName()  # no shuffle before it, so asking runs nothing
    return df.repartition(cores) if scans and planned.toRdd().getNumPartitions() < cores else df
