"""The engine: collections of text files, kept as an index, searched and looked up."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn import providers
from tarn.functions import paths as P
from tarn.operators import bm25, lookup, maintenance, segments, vectors
from tarn.operators.chunking import chunk_rows
from tarn.operators.snippets import Snippet, snippet
from tarn.plans import search as plans
from tarn.plans.querydoc import TypedQuery, parse_query_document, plain_text
from tarn.sources import files
from tarn.sources.snapshots import SCHEMAS, Warehouse

#: Texts embedded in one call, tries of a text, and the share of failures at which embedding stops (fixed values).
EMBED_BATCH, TRIES, MOST_FAILED = 32, 3, 0.8


class EngineError(ValueError):
    pass


class Engine:
    """An index in ``root``. One application writes to it at a time; any number read it. With the strategy "auto" program files are cut into chunks at their constructs."""

    def __init__(self, spark: SparkSession, root: str, config: dict | str | None = None, analyzer: str = "porter", models: plans.Models | None = None, strategy: str = "regex"):
        if strategy not in ("regex", "auto"):
            raise EngineError(f"not a way to chunk: {strategy}")
        self.spark, self.tables, self.analyzer, self.strategy = spark, Warehouse(spark, root), analyzer, strategy
        self.models = models or plans.Models(providers.HashEmbedder(), providers.PlainExpander(), providers.OverlapReranker())
        if config is not None:
            self.sync_config(files.load_config(config) if isinstance(config, str) else config)

    # configuration

    def sync_config(self, config: dict) -> bool:
        """Collections and settings as configured; whether anything had to change."""
        digest = providers.cache_key("config", repr(config))
        if self._config().get("config_hash") == digest:
            return False
        settings = {"config_hash": digest} | ({"global_context": config["global_context"]} if config.get("global_context") else {})
        self.tables.commit(collections=files.collections_frame(self.spark, config), config=self._frame("config", list(settings.items())))
        return True

    def _config(self) -> dict[str, str]:
        return {r[0]: r[1] for r in self.tables.read("config").collect()}

    def _frame(self, table: str, rows: list) -> DataFrame:
        return self.spark.createDataFrame(rows, SCHEMAS[table])

    def _collections(self) -> dict[str, dict]:
        return {r["name"]: r.asDict(recursive=True) for r in self.tables.read("collections").collect()}

    def _collections_frame(self, found: dict[str, dict]) -> DataFrame:
        names = [x.split()[0] for x in SCHEMAS["collections"].replace("map<string,string>", "m").split(", ")]
        return self._frame("collections", [tuple(c.get(n) for n in names) for c in found.values()])

    def _save_collections(self, found: dict[str, dict]) -> None:
        self.tables.commit(collections=self._collections_frame(found))

    def add_collection(self, name: str, path: str, pattern: str = files.PATTERN, ignore: list[str] | None = None, include_by_default: bool = True) -> None:
        if not re.fullmatch("[A-Za-z0-9_-]+", name):
            raise EngineError(f"not a collection's name: {name}")
        found = self._collections()
        context = (found.get(name) or {}).get("context") or {}
        found[name] = {"name": name, "path": path, "pattern": pattern, "ignore": list(ignore or []), "include_by_default": include_by_default, "update_command": None, "context": context}
        self._save_collections(found)

    def remove_collection(self, name: str) -> int:
        """Forget a collection and its documents; bodies that no active document has go too. How many documents there were."""
        found = self._collections()
        if found.pop(name, None) is None:
            raise EngineError(f"no collection {name}")
        docs = self.tables.read("documents")
        n = docs.where(F.col("collection") == name).count()
        rest = docs.where(F.col("collection") != name)
        content = self.tables.read("content")
        used = maintenance.active(rest).select("hash").distinct()
        rest, content = rest.join(used, "hash", "left_semi"), content.join(used, "hash", "left_semi")
        self.tables.commit(collections=self._collections_frame(found), documents=rest, content=content, **self._terms(rest, content))
        return n

    def rename_collection(self, old: str, new: str) -> None:
        found = self._collections()
        if old not in found or new in found:
            raise EngineError(f"no collection {old}" if old not in found else f"there is a collection {new}")
        named = self._collections_frame({(new if k == old else k): (v | {"name": new} if k == old else v) for k, v in found.items()})
        docs = self.tables.read("documents").withColumn("collection", F.when(F.col("collection") == old, new).otherwise(F.col("collection")))
        self.tables.commit(collections=named, documents=docs, **self._terms(docs, self.tables.read("content")))

    def list_collections(self) -> DataFrame:
        return maintenance.collections_listing(self.tables.read("collections"), self.tables.read("documents"))

    def default_collections(self) -> list[str]:
        return [n for n, c in self._collections().items() if c["include_by_default"]]

    def set_context(self, collection: str, prefix: str, text: str | None) -> None:
        """A context for a path's prefix; None deletes it."""
        found = self._collections()
        if collection not in found:
            raise EngineError(f"no collection {collection}")
        context = {k: v for k, v in (found[collection]["context"] or {}).items() if k != prefix}
        found[collection]["context"] = context | ({prefix: text} if text is not None else {})
        self._save_collections(found)

    def set_global_context(self, text: str | None) -> None:
        rest = {k: v for k, v in self._config().items() if k != "global_context"}
        self.tables.commit(config=self._frame("config", list((rest | ({"global_context": text} if text else {})).items())))

    def list_contexts(self) -> list[tuple[str, str, str]]:
        """(collection, prefix, context): the longest prefix of each collection first; the global one under "*"."""
        rows = [(n, p, t) for n, c in self._collections().items() for p, t in (c["context"] or {}).items()]
        top = self._config().get("global_context")
        return ([("*", "/", top)] if top else []) + sorted(rows, key=lambda r: (r[0], -len(r[1]), r[1]))

    def _prefixes(self) -> DataFrame:
        return self.tables.read("collections").select(F.col("name").alias("collection"), F.explode("context").alias("prefix", "context"))

    # index

    def update(self, collections: list[str] | None = None) -> dict[str, int]:
        """Scan collections and bring documents, bodies and terms up to date, in one commit; what changed. Files are read once: all is derived from what that reading gave."""
        found = self._collections()
        docs, content, total = self.tables.read("documents"), self.tables.read("content"), {"indexed": 0, "updated": 0, "unchanged": 0, "removed": 0}
        now = F.lit(datetime.datetime.now(datetime.UTC).replace(tzinfo=None))
        for name in collections or list(found):
            c = found[name]
            new = files.scan(self.spark, c["path"], c["pattern"] or files.PATTERN, c["ignore"]).withColumn("collection", F.lit(name))
            new = self.tables.staged(new)
            own = maintenance.with_adopted_paths(docs.where(F.col("collection") == name), new)
            counts = maintenance.change_counts(maintenance.changes(own, new)).first().asDict()
            total = {k: total[k] + counts[k] for k in total}
            docs = docs.where(F.col("collection") != name).unionByName(maintenance.refreshed(own, new, now)) if new.limit(1).count() else docs.withColumn("active", F.col("active") & (F.col("collection") != name))
            fresh = new.select("hash", "doc").dropDuplicates(["hash"]).join(content.select("hash"), "hash", "left_anti").withColumn("created_at", now)
            docs, content = self.tables.staged(docs), content.unionByName(fresh)
        content = self.tables.staged(content)
        self.tables.commit(cache=self._frame("cache", []), documents=docs, content=content, **self._terms(docs, content))
        self.tables.drop_staged()
        return total

    def apply(self, collection: str, events: DataFrame) -> dict[str, int]:
        """Bring just these files of a collection up to date (events: path below its folder, modified_at as listed, change: added, changed or gone; one row a path); what changed. No other file is read, and what isn't changed by hash stays as it is, so the same events may come twice."""
        c = self._collections()[collection]
        docs, content = self.tables.read("documents"), self.tables.read("content")
        events, now = self.tables.staged(events.select("path", "modified_at", "change")), F.lit(datetime.datetime.now(datetime.UTC).replace(tzinfo=None))
        new = files.scan(self.spark, c["path"], c["pattern"] or files.PATTERN, c["ignore"], events.where("change <> 'gone'"))
        new = self.tables.staged(new.withColumn("collection", F.lit(collection)))
        named = (F.col("collection") == collection) & F.col("named").isNotNull()
        marked = docs.join(events.select("path", F.lit(True).alias("named")), "path", "left")
        own, rest = marked.where(named).drop("named"), marked.where(~named).drop("named")
        counts = maintenance.change_counts(maintenance.changes(own, new)).first().asDict()
        after = maintenance.refreshed(own, new, now) if not new.isEmpty() else own.withColumn("active", F.lit(False))
        fresh = new.select("hash", "doc").dropDuplicates(["hash"]).join(content.select("hash"), "hash", "left_anti").withColumn("created_at", now)
        if any(counts[k] for k in ("indexed", "updated", "removed")):
            docs, content = self.tables.staged(rest.unionByName(after)), self.tables.staged(content.unionByName(fresh))
            self.tables.commit(cache=self._frame("cache", []), documents=docs, content=content, **self._terms(docs, content))
        self.tables.drop_staged()
        return counts

    def _terms(self, docs: DataFrame, content: DataFrame) -> dict[str, list]:
        """The keyword index' segments for these documents and bodies: one more, of what changed, and perhaps one in the place of several. Nothing of an unchanged document is read."""
        keyed = lambda x: maintenance.active(x).select(F.xxhash64("collection", "path").alias("doc_id"), "collection", "path", "title", "hash")
        bodies = lambda d, c: d.join(c.select("hash", F.col("doc").alias("body")), "hash")
        old, new, same = keyed(self.tables.read("documents")), keyed(docs), ["doc_id", "title", "hash"]
        gone = self.tables.staged(bodies(old.join(new.select(same), same, "left_anti"), self.tables.read("content")))
        fresh = self.tables.staged(bodies(new.join(old.select(same), same, "left_anti"), content))
        known = self.tables.segments()
        if fresh.isEmpty() and gone.isEmpty():
            return {"segments": known}
        number = known[-1][0] + 1 if known else 1
        paired = list(self.tables.read_segments(known[:1])["totals"].first()["paired"] or []) if known else segments.paired_words(fresh, self.analyzer)
        known = [*known, self.tables.write_segment(number, segments.made(fresh, gone, self.analyzer, number, paired, gone.select("doc_id")))]
        run = segments.to_merge([(n, size) for n, _, size in known])
        if run:
            tables = self.tables.read_segments([k for k in known if k[0] in run])
            one = self.tables.write_segment(run[-1], segments.merged(tables, run, run[0] == known[0][0]))
            known = [*(k for k in known if k[0] not in run), one]
        return {"segments": known}

    def _searched(self) -> plans.Index:
        tables = self.tables.pinned()
        docs = maintenance.active(tables.read("documents")).withColumn("doc_id", F.xxhash64("collection", "path"))
        chunks, stored = tables.read("chunks"), tables.read("vectors")
        placed = stored.join(chunks.select("hash", "seq", "pos"), ["hash", "seq"])
        return plans.Index(docs, tables.read("content"), tables.keyword_index(), placed, self.analyzer)

    def pending(self) -> DataFrame:
        e = self.models.embedder
        return maintenance.pending(self.tables.read("documents"), self.tables.read("content"), self.tables.read("chunks"), e.name, providers.fingerprint(e.name))

    def _chunks(self, of: DataFrame) -> DataFrame:
        """Chunks, with titles, of the active bodies whose hash ``of`` has."""
        named = maintenance.active(self.tables.read("documents")).join(of.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.min("title").alias("title"), F.min("path").alias("path"))
        bodies = self.tables.read("content").select("hash", "doc").join(named.select("hash", "path"), "hash")
        return chunk_rows(bodies, self.strategy).join(named.select("hash", "title"), "hash")

    def embed(self, force: bool = False, collection: str | None = None) -> dict[str, int]:
        """Chunk and embed the bodies that lack vectors. A body with a chunk that can't be embedded is left for the next time."""
        if force:
            self.clear_embeddings(collection)
        e, print_ = self.models.embedder, providers.fingerprint(self.models.embedder.name)
        todo = self.pending()
        rows = self._chunks(todo)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for at in range(0, len(pdf), EMBED_BATCH):
                    some = pdf.iloc[at : at + EMBED_BATCH]
                    prompts = [providers.document_prompt(t, title, e.name) for t, title in zip(some["text"], some["title"])]
                    found: list = [None] * len(prompts)
                    for _ in range(TRIES):
                        left = [k for k, v in enumerate(found) if v is None]
                        if not left:
                            break
                        try:
                            for k, v in zip(left, e.embed([prompts[k] for k in left])):
                                found[k] = v
                        except Exception:  # noqa: BLE001  a provider's failure of any kind is a failed text, tried again
                            continue
                    yield some[["hash", "seq", "pos", "total_chunks"]].assign(embedding=found)

        schema = "hash string, seq int, pos int, total_chunks int, embedding array<float>"
        # written once: both tables and all counts come from the same answers of the provider
        raw = self.tables.staged(rows.select("hash", "seq", "pos", "text", "title", "total_chunks").mapInPandas(run, schema))
        failed = raw.where("embedding IS NULL").select("hash").distinct()
        done = raw.join(failed, "hash", "left_anti")
        now = F.lit(datetime.datetime.now(datetime.UTC).replace(tzinfo=None))
        fresh = done.select("hash", "seq", "pos", F.lit(e.name).alias("model"), F.lit(print_).alias("fingerprint"), "total_chunks", now.alias("embedded_at"))
        old = self.tables.read("chunks")
        gone = todo.select("hash").unionByName(maintenance.incomplete(old).select("hash")).distinct()
        expected, n, n_failed = raw.count(), done.count(), failed.count()
        self.tables.commit(
            chunks=old.join(gone, "hash", "left_anti").unionByName(fresh),
            vectors=self.tables.read("vectors").join(gone, "hash", "left_anti").unionByName(done.select("hash", "seq", "embedding")),
        )
        self.tables.drop_staged()
        if expected and 1 - n / expected > MOST_FAILED:
            raise EngineError(f"embedding failed: {expected - n} of {expected} chunks")
        return {"chunks": n, "incomplete": n_failed}

    def clear_embeddings(self, collection: str | None = None) -> None:
        docs = self.tables.read("documents")
        self.tables.commit(**{t: maintenance.without_embeddings(self.tables.read(t), docs, collection) for t in ("chunks", "vectors")})

    # search

    def search(self, query: str, *, collections: list[str] | None = None, limit: int = plans.LIMIT, least: float = 0.0, rerank: bool = True, intent: str | None = None, explain: bool = False) -> list[plans.Found]:
        """A plain query, or a query document of typed lines."""
        typed = parse_query_document(query)
        scope = collections or self.default_collections()
        options = {"limit": limit, "least": least, "collections": scope, "rerank": rerank, "explain": explain}
        if typed:
            return plans.structured(self.spark, self._searched(), self.models, list(typed.searches), intent=intent or typed.intent, **options)
        return plans.hybrid(self.spark, self._searched(), self.models, plain_text(query), intent=intent, **options)

    def search_structured(self, queries: list[tuple[str, str]], **options) -> list[plans.Found]:
        return plans.structured(self.spark, self._searched(), self.models, [TypedQuery(t, q) for t, q in queries], **options)

    def search_lex(self, query: str, collections: list[str] | None = None, limit: int = 20) -> DataFrame:
        index = self._searched()
        from tarn.plans import lexquery

        lexquery.validate_lex(query)
        plan = lexquery.parse(query, self.analyzer)
        if collections and len(collections) > 1:
            return bm25.search_each(index.terms, index.docs, plan, limit, collections)
        return bm25.search(index.terms, index.docs, plan, limit, collections)

    def search_vector(self, query: str, collections: list[str] | None = None, limit: int = plans.LIMIT, least: float = plans.LEAST_BY_MEANING) -> list[plans.Found]:
        return plans.by_meaning(self._searched(), self.models, query, limit=limit, least=least, collections=collections)

    def expand_query(self, query: str) -> list[tuple[str, str]]:
        return self.models.expanded(query)

    def save_cache(self) -> None:
        """Keep the providers' answers, the newest thousand, for other sessions."""
        now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
        rows = self._frame("cache", [(k, json.dumps(v), now) for k, v in self.models.cache.items()])
        self.tables.commit(cache=maintenance.newest(maintenance.upsert(self.tables.read("cache"), rows, ["cache_key"])))

    def load_cache(self) -> int:
        kept = {r["cache_key"]: json.loads(r["result"]) for r in maintenance.newest(self.tables.read("cache")).collect()}
        self.models.cache.update({k: [tuple(x) for x in v] if isinstance(v, list) else v for k, v in kept.items()})
        return len(kept)

    def check_embeddings(self, n: int = 20, of: DataFrame | None = None) -> DataFrame:
        """A sample of stored vectors (or of those given) against vectors made anew."""
        some = vectors.sample(self.tables.read("vectors") if of is None else of, n)
        rows = self._chunks(some).join(some.select("hash", "seq"), ["hash", "seq"]).collect()  # n at most
        e = self.models.embedder
        again = e.embed([providers.document_prompt(r["text"], r["title"], e.name) for r in rows])
        fresh = self.spark.createDataFrame([(r["hash"], r["seq"], v) for r, v in zip(rows, again)], "hash string, seq int, embedding array<double>")
        return vectors.check_samples(some, fresh)

    def adopt_embeddings(self, n: int = 20) -> bool:
        """Take over the model's chunks that name no fingerprint, if a sample of their vectors comes out the same anew; else they stay pending."""
        name = self.models.embedder.name
        chunks, unnamed = self.tables.read("chunks"), (F.col("model") == name) & (F.coalesce("fingerprint", F.lit("")) == "")
        own = self.tables.read("vectors").join(chunks.where(unnamed).select("hash", "seq"), ["hash", "seq"], "left_semi")
        found = self.check_embeddings(n, own).collect()  # n at most
        if not found or not all(r["ok"] for r in found):
            return False
        self.tables.commit(chunks=chunks.withColumn("fingerprint", F.when(unnamed, providers.fingerprint(name)).otherwise(F.col("fingerprint"))))
        return True

    def snippet_of(self, found: plans.Found, query: str, most: int = 500, intent: str | None = None) -> Snippet:
        return snippet(found.body, query, most, found.best_chunk_pos, len(found.best_chunk) or None, intent)

    # documents

    def _docs(self) -> DataFrame:
        return maintenance.active(self.tables.read("documents"))

    def get(self, name: str) -> dict:
        """A document by id, virtual path, path or a path's end; where there is none, what it may have meant."""
        r = lookup.resolve(self._docs(), self.spark.createDataFrame([(name,)], "name string")).first()
        if r["status"] == "found":
            own = self._docs().where((F.col("collection") == r["collection"]) & (F.col("path") == r["path"]))
            row = lookup.contexts(own, self._prefixes(), self._config().get("global_context")).first()
            return row.asDict() | {"docid": row["hash"][:6], "file": f"{P.SCHEME}{row['collection']}/{row['path']}"}
        near = lookup.similar(self._docs(), name.rsplit("//", 1)[-1])
        hidden = [(n, rule) for n, c in self._collections().items() for rule in [g for g in c["ignore"] or [] if re.match(P.glob_regex(g, True), name.removeprefix(f"{n}/"))][:1]]
        return {"error": r["status"], "ignored_by": hidden[0] if hidden else None, "similar": [x["path"] for x in near.collect()]}

    def get_body(self, name: str, first: int | None = None, count: int | None = None) -> str | None:
        """A document's text; a range can also follow its name ("a.md:120:40")."""
        name, given, most = lookup.split_range(name)
        first, count = first or given, count or most
        found = self.get(name)
        if "error" in found:
            return None
        one = self.tables.read("content").where(F.col("hash") == found["hash"])
        return one.select(lookup.line_slice(F.col("doc"), first, count)).first()[0]

    def multi_get(self, names: str, most_bytes: int = lookup.MOST_BYTES, first: int | None = None, count: int | None = None) -> tuple[DataFrame, list[str]]:
        """Documents of a comma list or a glob, with bodies, and what went wrong."""
        docs, errors = self._docs(), []
        if any(c in names for c in "*?[{"):
            found = lookup.by_globs(docs, names)
            if not found.limit(1).count():
                errors.append(f"no document matches {names}")
        else:
            asked = [x.strip() for x in names.split(",") if x.strip()]
            got = lookup.resolve(docs, self.spark.createDataFrame([(n,) for n in asked], "name string"))
            errors = [f"{r['name']}: {r['status']}" for r in got.where("status != 'found'").orderBy("name").collect()]
            found = docs.join(got.where("status = 'found'").select("collection", "path").distinct(), ["collection", "path"], "left_semi")
        found = lookup.contexts(found, self._prefixes(), self._config().get("global_context"))
        out = lookup.with_bodies(found, self.tables.read("content"), most_bytes, first, count)
        return out.withColumn("file", P.virtual_path(F.col("collection"), F.col("path"))), errors

    def list_files(self, collection: str, prefix: str = "") -> DataFrame:
        return lookup.listing(self._docs(), self.tables.read("content"), collection, prefix)

    # state and maintenance

    def status(self) -> DataFrame:
        return maintenance.status(self.tables.read("documents"))

    def health(self) -> DataFrame:
        return maintenance.health(self.tables.read("documents"), self.pending(), F.current_timestamp())

    def preview_cleanup(self) -> dict[str, int]:
        t = self.tables.read
        return maintenance.cleanup_preview(t("documents"), t("content"), t("chunks"), t("cache")).first().asDict()

    def cleanup(self) -> dict[str, int]:
        """Drop cached answers, inactive documents, bodies and vectors that nothing uses, and old versions of tables."""
        found, t = self.preview_cleanup(), self.tables.read
        docs = maintenance.active(t("documents"))
        used = docs.select("hash").distinct()
        self.tables.commit(
            cache=self._frame("cache", []), documents=docs, content=t("content").join(used, "hash", "left_semi"),
            chunks=t("chunks").join(used, "hash", "left_semi"), vectors=t("vectors").join(used, "hash", "left_semi"),
        )
        self.models.cache.clear()
        self.tables.vacuum()
        return found
