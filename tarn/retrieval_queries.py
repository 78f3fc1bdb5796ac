"""Queries over the given tables for the engine's operators, each with its SQL.

The tables stand for an index by conventions of this module: a document's
collection is its source, its path lang/doc_id.md, its title its number; documents
whose number 7 divides are inactive; vector v belongs to document v % 200 as chunk
v div 200; the earlier state of the index lacks documents whose number 10 divides,
has other text where 11 divides it and other titles where 17 does, and has paths of
its own where 13 does.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn import providers
from tarn.functions import paths as P
from tarn.functions import text as T
from tarn.functions.pieces import by_pieces
from tarn.operators import bm25, evaluation, expansion, formatters, fusion, lookup, maintenance, ranking, segments, vector_index, vectors
from tarn.operators.chunking import chunk_rows
from tarn.operators.snippets import snippets
from tarn.plans import batch, search
from tarn.plans.benchmark import Fixture, FixtureQuery, run_fixture
from tarn.plans.lexquery import parse
from tarn.plans.querydoc import TypedQuery
from tarn.sources import files
from tarn.sources.snapshots import Warehouse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# frames


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, collection, path, title, hash, body, active, modified_at."""
    body = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("collection"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("doc_id").cast("string").alias("title"), P.content_hash(body).alias("hash"), body.alias("body"), (F.col("doc_id") % 7 != 0).alias("active"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("modified_at"),
    )


DOCS = """docs AS (
  SELECT doc_id, source AS collection, lang || '/' || doc_id || '.md' AS path, CAST(doc_id AS VARCHAR) AS title,
    sha256(coalesce(text, '')) AS hash, coalesce(text, '') AS body, doc_id % 7 <> 0 AS active,
    TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)) AS modified_at
  FROM documents)"""


def scan(spark: SparkSession, d: str) -> bm25.Scan:
    return bm25.Scan(files.spread(documents(spark, d)))


ARRAYS = DOCS + r""",
arrays AS (
  SELECT doc_id, 'filepath' AS field, regexp_extract_all(lower(collection || '/' || path), '[\p{L}\p{N}]+') AS a FROM docs
  UNION ALL SELECT doc_id, 'title', regexp_extract_all(lower(title), '[\p{L}\p{N}]+') FROM docs
  UNION ALL SELECT doc_id, 'body', regexp_extract_all(lower(body), '[\p{L}\p{N}]+') FROM docs),
toks AS (SELECT doc_id, field, unnest(a) AS term, generate_subscripts(a, 1) AS pos FROM arrays),
dls AS (SELECT doc_id, sum(len(a)) AS dl FROM arrays GROUP BY doc_id),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls)"""


def _phrase_sql(p, k: int) -> str:
    def fits(alias: str, i: int) -> str:
        word = p.tokens[i]
        return f"starts_with({alias}.term, '{word}')" if p.prefix and i == len(p.tokens) - 1 else f"{alias}.term = '{word}'"

    joins = "".join(f" JOIN toks t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.field = t0.field AND t{i}.pos = t0.pos + {i} AND {fits(f't{i}', i)}" for i in range(1, len(p.tokens)))
    return f"SELECT {k} AS phrase, t0.doc_id, sum(CASE t0.field WHEN 'filepath' THEN 1.5 WHEN 'title' THEN 4.0 ELSE 1.0 END) AS f FROM toks t0{joins} WHERE {fits('t0', 0)} GROUP BY t0.doc_id"


def lex_sql(text: str, tail: str) -> str:
    """BM25 of a keyword query in plain SQL; ``tail`` selects from ``found`` (doc_id, score) and ``docs``."""
    plan = parse(text)
    hits = " UNION ALL ".join(_phrase_sql(p, k) for k, p in enumerate(plan.positive))
    no = "".join(f" AND doc_id NOT IN ({' INTERSECT '.join(f'SELECT doc_id FROM ({_phrase_sql(p, 0)})' for p in group)})" for group in plan.negative)
    return f"""WITH {ARRAYS},
hits AS ({hits}),
dfs AS (SELECT phrase, count(*) AS df FROM hits GROUP BY phrase),
idfs AS (SELECT phrase, CASE WHEN (n - df + 0.5) / (df + 0.5) <= 1 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM dfs, corpus),
raw AS (
  SELECT h.doc_id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS x, count(*) AS got
  FROM hits h JOIN idfs USING (phrase) JOIN dls ON dls.doc_id = h.doc_id, corpus GROUP BY h.doc_id),
found AS (SELECT doc_id, x / (1 + x) AS score FROM raw WHERE got = {len(plan.positive)}{no})
{tail}"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "collection", "path", F.round("score", 6).alias("score"))


TOP = "SELECT doc_id, collection, path, round(score, 6) AS score FROM found JOIN docs USING (doc_id) ORDER BY round(found.score, 12) DESC, doc_id LIMIT 20"

# keyword search


def _lex(name: str, text: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _shown(bm25.search(scan(spark, d), documents(spark, d), parse(text), 20))

    run.__name__ = name
    query(lex_sql(text, TOP))(run)


for _name, _text in {
    "bm25_term": '"apache"', "bm25_and": "license version", "bm25_not": "license -apache", "bm25_prefix": "licen", "bm25_phrase": '"mit license"',
    "bm25_dotted": "4.0", "bm25_hyphenated": "by-nc", "bm25_not_phrase": 'license -"general public"', "bm25_field_weights": "src3 en", "bm25_frequent_term": "the", "bm25_mixed": '"licensed under" apache 2.0 -gnu',
}.items():
    _lex(_name, _text)

SCOPE = ["src1", "src2", "src3"]


@query(lex_sql("license", "SELECT doc_id, collection, path, round(score, 6) AS score FROM found JOIN docs USING (doc_id) WHERE collection IN ('src1', 'src2', 'src3') ORDER BY round(found.score, 12) DESC, doc_id LIMIT 20"))
def bm25_scoped(spark, d):
    return _shown(bm25.search(scan(spark, d), documents(spark, d), parse("license"), 20, SCOPE))


@query(lex_sql("the", """, own AS (
  SELECT doc_id, collection, path, score, row_number() OVER (PARTITION BY collection ORDER BY round(score, 12) DESC, doc_id) AS r
  FROM found JOIN docs USING (doc_id) WHERE collection IN ('src1', 'src2', 'src3'))
SELECT doc_id, collection, path, round(score, 6) AS score FROM own WHERE r <= 5 ORDER BY round(own.score, 12) DESC, doc_id LIMIT 5"""))
def bm25_multi_collection_merge(spark, d):
    return _shown(bm25.search_each(scan(spark, d), documents(spark, d), parse("the"), 5, SCOPE))


@query(lex_sql('"licensed under" version', TOP))
def bm25_inverted_index(spark, d):
    return _shown(bm25.search(bm25.Postings.build(files.spread(documents(spark, d))), documents(spark, d), parse('"licensed under" version'), 20))


def stored_index(spark: SparkSession, d: str) -> Warehouse:
    """The documents' keyword index in the warehouse folder: built when it isn't there, or when the documents' files have changed."""
    source = documents(spark, d)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    changed = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    name = providers.cache_key("index", d, str(changed))[:16]
    kept = Warehouse(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/tarn-index-{name}")
    if not kept.exists():
        kept.commit(segments=[kept.write_segment(1, segments.single(files.spread(source)))])
    return kept


@query(lex_sql('"licensed under" version', TOP))
def bm25_stored_index(spark, d):
    return _shown(bm25.search(stored_index(spark, d).keyword_index(), documents(spark, d), parse('"licensed under" version'), 20))


@query(f"WITH {ARRAYS} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, CAST((SELECT sum(dl) FROM dls) AS BIGINT) AS n_tokens FROM corpus")
def corpus_stats(spark, d):
    return scan(spark, d).lengths().agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("dl"), 6).alias("avgdl"), F.sum("dl").alias("n_tokens"))


@query(f"WITH {ARRAYS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM toks GROUP BY term")
def postings_df(spark, d):
    return bm25.Postings.build(files.spread(documents(spark, d))).dictionary()


# the only stems that begin with licens and version are those of words that do
@query(lex_sql("licens version", TOP))
def porter_search(spark, d):
    docs = documents(spark, d)
    index = bm25.Scan(files.spread(docs), "porter")
    return _shown(bm25.search(index, docs, parse("licensing versions", "porter"), 20))


# index state


def earlier(spark: SparkSession, d: str) -> DataFrame:
    """The index before: collection, path, title, hash, created_at, modified_at, active."""
    docs, n = documents(spark, d), F.col("doc_id")
    kept = docs.where(n % 10 != 0).withColumn("hash", F.when(n % 11 == 0, P.content_hash(F.concat(F.lit("old"), F.col("body")))).otherwise(F.col("hash")))
    kept = kept.withColumn("title", F.when(n % 17 == 0, "old title").otherwise(F.col("title")))
    own = docs.where(n % 13 == 0).withColumn("path", F.concat(F.lit("old/"), F.col("path")))
    return kept.unionByName(own).select("collection", "path", "title", "hash", F.col("modified_at").alias("created_at"), "modified_at", "active")


EARLIER = DOCS + """,
earlier AS (
  SELECT collection, path, CASE WHEN doc_id % 17 = 0 THEN 'old title' ELSE title END AS title,
    CASE WHEN doc_id % 11 = 0 THEN sha256('old' || body) ELSE hash END AS hash, modified_at, active
  FROM docs WHERE doc_id % 10 <> 0
  UNION ALL SELECT collection, 'old/' || path, title, hash, modified_at, active FROM docs WHERE doc_id % 13 = 0)"""


@query(f"WITH {DOCS} SELECT hash, count(*) AS n_docs FROM docs GROUP BY hash")
def content_dedup(spark, d):
    return maintenance.content_table(documents(spark, d).withColumnRenamed("body", "doc")).select("hash", "n_docs")


CHANGES = EARLIER + """,
changed AS (
  SELECT coalesce(o.collection, n.collection) AS collection, coalesce(o.path, n.path) AS path,
    CASE WHEN n.hash IS NOT NULL AND o.hash IS NULL THEN 'added' WHEN n.hash IS NOT NULL AND NOT o.active THEN 'reactivated'
      WHEN n.hash IS NOT NULL AND o.hash <> n.hash THEN 'updated' WHEN n.hash IS NOT NULL AND o.title IS DISTINCT FROM n.title THEN 'retitled'
      WHEN n.hash IS NOT NULL THEN 'unchanged' WHEN o.active THEN 'removed' ELSE 'gone' END AS change
  FROM earlier o FULL JOIN docs n ON o.collection = n.collection AND o.path = n.path)"""


@query(f"WITH {CHANGES} SELECT collection, path, change FROM changed")
def doc_diff_change_types(spark, d):
    return maintenance.changes(earlier(spark, d), documents(spark, d))


@query(f"""WITH {CHANGES} SELECT count(*) FILTER (change IN ('added', 'reactivated')) AS indexed, count(*) FILTER (change IN ('updated', 'retitled')) AS updated,
  count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change = 'removed') AS removed FROM changed""")
def reindex_counts(spark, d):
    return maintenance.change_counts(maintenance.changes(earlier(spark, d), documents(spark, d)))


@query(f"""WITH {EARLIER}, new AS (SELECT * FROM docs WHERE collection <> 'src0')
SELECT coalesce(o.collection, n.collection) AS collection, coalesce(o.path, n.path) AS path,
  CASE WHEN n.hash IS NOT NULL THEN true WHEN coalesce(o.collection, n.collection) <> 'src0' THEN false ELSE o.active END AS active, coalesce(n.hash, o.hash) AS hash
FROM earlier o FULL JOIN new n ON o.collection = n.collection AND o.path = n.path""")
def deactivate_missing(spark, d):
    new = documents(spark, d).where("collection <> 'src0'")
    return maintenance.refreshed(earlier(spark, d), new, F.current_timestamp()).select("collection", "path", "active", "hash")


def content(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).groupBy("hash").agg(F.first("body").alias("doc"))


def chunks(spark: SparkSession, d: str, docs: DataFrame | None = None) -> DataFrame:
    """hash, seq, pos, model, fingerprint, total_chunks by the convention of vectors; every document is to have three chunks."""
    v = F.col("vec_id")
    e = table(spark, d, "embeddings").select((v % 200).alias("doc_id"), F.floor(v / 200).cast("int").alias("seq"), "embedding")
    own = (documents(spark, d) if docs is None else docs).select("doc_id", "hash")
    return e.join(own, "doc_id").select(
        "doc_id", "hash", "seq", (F.col("seq") * 3060).alias("pos"), F.when(F.col("doc_id") % 5 == 0, "other").otherwise("model").alias("model"),
        F.lit("abc123").alias("fingerprint"), F.lit(3).alias("total_chunks"), "embedding",
    )


CHUNKS = DOCS + """,
chunks AS (
  SELECT d.doc_id, d.hash, CAST(vec_id // 200 AS INTEGER) AS seq, CAST(vec_id // 200 AS INTEGER) * 3060 AS pos, CASE WHEN d.doc_id % 5 = 0 THEN 'other' ELSE 'model' END AS model,
    'abc123' AS fingerprint, 3 AS total_chunks, CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings e JOIN docs d ON d.doc_id = e.vec_id % 200)"""

COMPLETE = "SELECT hash FROM chunks WHERE model = 'model' AND fingerprint = 'abc123' GROUP BY hash HAVING count(*) >= max(total_chunks)"


@query(f"""WITH {CHUNKS} SELECT hash, min(path) AS path, CAST(max(octet_length(encode(body))) AS BIGINT) AS n_bytes FROM docs
WHERE active AND hash NOT IN ({COMPLETE}) GROUP BY hash""")
def pending_embeddings(spark, d):
    return maintenance.pending(documents(spark, d), content(spark, d), chunks(spark, d), "model", "abc123")


@query(f"WITH {CHUNKS} SELECT count(DISTINCT hash) AS needs_embedding FROM docs WHERE active AND hash NOT IN ({COMPLETE})")
def needs_embedding_count(spark, d):
    return pending_embeddings(spark, d).agg(F.count_distinct("hash").alias("needs_embedding"))


@query(f"WITH {CHUNKS} SELECT hash, count(*) AS n, max(total_chunks) AS total FROM chunks GROUP BY hash HAVING count(*) < max(total_chunks)")
def incomplete_embeddings(spark, d):
    return maintenance.incomplete(chunks(spark, d))


@query(f"WITH {DOCS} SELECT hash FROM (SELECT DISTINCT hash FROM docs) WHERE hash NOT IN (SELECT hash FROM docs WHERE doc_id % 3 = 0)")
def orphaned_content(spark, d):
    return maintenance.orphaned_content(content(spark, d), documents(spark, d).where("doc_id % 3 = 0")).select("hash")


@query(f"WITH {CHUNKS} SELECT hash, seq FROM chunks WHERE hash NOT IN (SELECT hash FROM docs WHERE active)")
def orphaned_vectors(spark, d):
    return maintenance.orphaned_vectors(chunks(spark, d), documents(spark, d)).select("hash", "seq")


@query(f"WITH {CHUNKS} SELECT model, fingerprint, count(DISTINCT hash) AS n_hashes, count(*) AS n_chunks FROM chunks GROUP BY model, fingerprint")
def fingerprint_census(spark, d):
    return maintenance.fingerprint_census(chunks(spark, d))


@query(f"WITH {DOCS} SELECT hash FROM docs WHERE active GROUP BY hash HAVING min(collection) = 'src1' AND max(collection) = 'src1'")
def exclusive_hashes(spark, d):
    return maintenance.exclusive_hashes(documents(spark, d), "src1")


@query(f"""WITH {CHUNKS} SELECT hash, seq FROM chunks WHERE hash NOT IN
  (SELECT hash FROM docs WHERE active GROUP BY hash HAVING min(collection) = 'src1' AND max(collection) = 'src1')""")
def clear_collection_embeddings(spark, d):
    return maintenance.without_embeddings(chunks(spark, d), documents(spark, d), "src1").select("hash", "seq")


def _names(spark):
    return spark.createDataFrame([(f"src{k}",) for k in range(25)], "name string")


NAMES = "names AS (SELECT 'src' || k AS name FROM range(25) t(k))"


@query(f"""WITH {DOCS}, {NAMES} SELECT name, count(doc_id) AS n_docs, count(*) FILTER (active) AS n_active, max(modified_at) AS last_modified
FROM names LEFT JOIN docs ON collection = name GROUP BY name""")
def collection_listing(spark, d):
    return maintenance.collections_listing(_names(spark), documents(spark, d))


@query(f"WITH {DOCS} SELECT collection, count(*) AS n_active, max(modified_at) AS last_modified FROM docs WHERE active GROUP BY collection")
def index_status(spark, d):
    return maintenance.status(documents(spark, d))


@query(f"""WITH {CHUNKS} SELECT count(*) AS total_docs, (SELECT count(DISTINCT hash) FROM docs WHERE active AND hash NOT IN ({COMPLETE})) AS needs_embedding,
  CAST(floor(epoch(TIMESTAMP '2025-01-01' - max(modified_at)) / 86400) AS INTEGER) AS days_stale FROM docs WHERE active""")
def index_health(spark, d):
    return maintenance.health(documents(spark, d), pending_embeddings(spark, d), F.lit("2025-01-01").cast("timestamp"))


@query(f"""WITH {CHUNKS} SELECT (SELECT count(*) FROM docs WHERE NOT active) AS inactive_documents,
  (SELECT count(DISTINCT hash) FROM docs WHERE hash NOT IN (SELECT hash FROM docs WHERE doc_id % 3 = 0)) AS orphaned_content,
  (SELECT count(*) FROM chunks WHERE hash NOT IN (SELECT hash FROM docs WHERE active AND doc_id % 3 = 0)) AS orphaned_vectors,
  (SELECT count(*) FROM labels) AS cached_responses, (SELECT count(*) FROM docs WHERE active) AS n_active""")
def cleanup_preview(spark, d):
    docs = documents(spark, d)
    third, all_ = docs.where("doc_id % 3 = 0"), docs
    got = maintenance.cleanup_preview(third, content(spark, d), chunks(spark, d), table(spark, d, "labels"))
    n = all_.agg(F.count_if(~F.col("active")).alias("inactive_documents"), F.count_if("active").alias("n_active"))
    return got.drop("inactive_documents").crossJoin(n)


@query("SELECT CAST(doc_id AS VARCHAR) AS cache_key, quality AS result, toxic AS created_at FROM labels ORDER BY toxic DESC, CAST(doc_id AS VARCHAR) LIMIT 100")
def cache_eviction(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("cache_key"), F.col("quality").alias("result"), F.col("toxic").alias("created_at"))
    return maintenance.newest(rows, 100)


@query(f"""WITH {DOCS}, new AS (SELECT collection, path, 'new' AS title FROM docs WHERE doc_id % 4 = 0)
SELECT collection, path, title FROM new UNION ALL SELECT collection, path, title FROM docs WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.collection = docs.collection AND n.path = docs.path)""")
def upsert_documents(spark, d):
    docs = documents(spark, d).select("collection", "path", "title")
    new = documents(spark, d).where("doc_id % 4 = 0").select("collection", "path", F.lit("new").alias("title"))
    return maintenance.upsert(docs, new, ["collection", "path"])


@query(f"WITH {DOCS} SELECT DISTINCT string_split(path, '/')[1] AS folder FROM docs WHERE active AND collection = 'src2' AND string_split(path, '/')[1] <> 'de'")
def folders_without_context(spark, d):
    return maintenance.top_folders(documents(spark, d), "src2", ["/de"])


@query(f"""WITH {DOCS}, {NAMES} SELECT name, count(doc_id) AS n_docs FROM names LEFT JOIN (SELECT * FROM docs WHERE active) x ON collection = name
WHERE name NOT IN ('src0', 'src1', 'src2') GROUP BY name""")
def collections_without_context(spark, d):
    some = F.when(F.col("name").isin("src0", "src1", "src2"), F.create_map(F.lit("/"), F.lit("about")))
    return maintenance.without_contexts(_names(spark).withColumn("context", some), documents(spark, d))


@query(f"""WITH {DOCS} SELECT collection, lang || '/a-b-' || doc_id || '.md' AS old_path, lang || '/a b (' || doc_id || ').md' AS path
FROM docs JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE doc_id % 3 = 0 AND active""")
def legacy_path_adoption(spark, d):
    docs = documents(spark, d).withColumn("folder", F.split("path", "/")[0])
    old = docs.where("doc_id % 3 = 0").withColumn("path", F.concat("folder", F.lit("/a-b-"), F.col("title"), F.lit(".md")))
    new = docs.withColumn("path", F.concat("folder", F.lit("/a b ("), F.col("title"), F.lit(").md")))
    return maintenance.adopted_paths(old, new)


# vector search


@query(f"WITH {CHUNKS}, f AS (SELECT hash, seq, CASE WHEN doc_id % 2 = 0 THEN embedding ELSE list_reverse(embedding) END AS again FROM chunks) SELECT c.hash, c.seq, 1 - list_cosine_similarity(embedding, again) <= 1e-4 AS ok FROM chunks c JOIN f USING (hash, seq)")
def embedding_samples(spark, d):
    c = chunks(spark, d)
    fresh = c.withColumn("embedding", F.when(F.col("doc_id") % 2 == 0, F.col("embedding")).otherwise(F.reverse("embedding")))
    return vectors.check_samples(c, fresh).select("hash", "seq", "ok")


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


NEAREST = CHUNKS + """,
q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
scored AS (SELECT doc_id, hash, seq, pos, list_cosine_similarity(embedding, q) AS score FROM chunks, q),
best AS (SELECT hash, seq, score FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY round(score, 12) DESC, seq) AS r FROM scored) WHERE r = 1),
found AS (SELECT d.doc_id, d.collection, d.path, b.seq, b.score FROM best b JOIN docs d USING (hash))"""
BEST = "SELECT doc_id, collection, path, seq, round(score, 6) AS score FROM found"


def _near(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "collection", "path", "seq", F.round("score", 6).alias("score"))


@query(f"WITH {NEAREST} {BEST} ORDER BY round(found.score, 12) DESC, doc_id LIMIT 20")
def knn_global(spark, d):
    return _near(vectors.search_vectors(chunks(spark, d), documents(spark, d), query_vector(spark, d)))


@query(f"WITH {NEAREST} {BEST} WHERE collection IN ('src1', 'src2', 'src3') ORDER BY round(found.score, 12) DESC, doc_id LIMIT 20")
def knn_scoped(spark, d):
    return _near(vectors.search_vectors(chunks(spark, d), documents(spark, d), query_vector(spark, d), 20, SCOPE))


@query(f"""WITH {NEAREST}, own AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY round(score, 12) DESC, doc_id) AS r FROM found WHERE collection IN ('src1', 'src2', 'src3'))
SELECT doc_id, collection, path, seq, round(score, 6) AS score FROM own WHERE r <= 4 ORDER BY round(own.score, 12) DESC, doc_id LIMIT 4""")
def knn_multi_collection(spark, d):
    return _near(vectors.search_vectors_each(chunks(spark, d), documents(spark, d), query_vector(spark, d), 4, SCOPE))


@query(f"WITH {CHUNKS}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) SELECT doc_id, round(max(list_cosine_similarity(embedding, q)), 6) AS score FROM chunks, q GROUP BY doc_id")
def knn_best_chunk_per_doc(spark, d):
    q = F.array(*(F.lit(float(x)) for x in query_vector(spark, d)))
    return chunks(spark, d).groupBy("doc_id").agg(F.round(F.max(1 - vectors.cosine_distance(F.col("embedding"), q)), 6).alias("score"))


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), e) AS dist FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 12), vec_id) AS n FROM s)
SELECT query_id, vec_id, round(dist, 6) + 0.0 AS distance FROM r WHERE n <= 10""")
def knn_query_set(spark, d):
    e = table(spark, d, "embeddings")
    some = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.nearest(e, some, 10).select("query_id", "vec_id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query("SELECT count(*) AS n_queries, 10 * count(*) AS n_exact, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def knn_index_recall(spark, d):
    """Approximate neighbours of a twentieth of the vectors against the exact ones: at least nine in ten have to be found."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    some = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    fitted = vector_index.fit(e)
    found = vector_index.nearest(vector_index.coded(e, fitted), e, fitted, some, 10)
    return vector_index.recall(found, vectors.nearest(e, some, 10)).select("n_queries", "n_exact", (F.col("recall") >= 0.9).alias("enough"))


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 20 = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS y FROM embeddings)
SELECT query_id, vec_id, round(list_cosine_distance(x, y), 6) + 0.0 AS distance FROM q, e QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_distance(x, y), 12), vec_id) = 1""")
def knn_indexed(spark, d):
    """The nearest vector by the index: a vector's own list is always probed."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    some = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    fitted = vector_index.fit(e)
    found = vector_index.nearest(vector_index.coded(e, fitted), e, fitted, some, 10)
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 12), "vec_id")
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", "vec_id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


# fusion


def lists(spark: SparkSession, d: str) -> DataFrame:
    """Three ranked lists of 20 documents for each of ten queries, in orders made of the documents' numbers."""
    docs = documents(spark, d).select("doc_id", F.concat_ws("/", "collection", "path").alias("file"))
    primes = F.array(F.lit(7919), F.lit(104729), F.lit(611953))
    one = docs.crossJoin(spark.range(10).withColumnRenamed("id", "query_id")).select("query_id", "doc_id", "file", F.posexplode(primes).alias("list_idx", "p"))  # ten rows
    one = one.withColumn("key", (F.col("doc_id") * F.col("p") + F.col("query_id") * 31) % 1009)
    w = Window.partitionBy("query_id", "list_idx").orderBy("key", "doc_id")
    top = one.withColumn("rank0", F.row_number().over(w) - 1).where("rank0 < 20")
    kind = F.element_at(F.array(F.lit("original"), F.lit("lex"), F.lit("vec")), F.col("list_idx") + 1)
    return top.select(
        "query_id", "list_idx", F.when(F.col("list_idx") == 2, "vec").otherwise("fts").alias("source"), kind.alias("query_type"), F.lit("q").alias("query"),
        "file", "rank0", (1 / (1 + F.col("rank0"))).alias("backend_score"), F.lit(1.0).alias("weight"),
    )


LISTS = DOCS + """,
lists AS (
  SELECT query_id, list_idx, CASE list_idx WHEN 0 THEN 'original' WHEN 1 THEN 'lex' ELSE 'vec' END AS query_type, file, rank0, 1.0 AS weight FROM (
    SELECT query_id, list_idx, file, row_number() OVER (PARTITION BY query_id, list_idx ORDER BY (doc_id * p + query_id * 31) % 1009, doc_id) - 1 AS rank0
    FROM (SELECT doc_id, collection || '/' || path AS file FROM docs), range(10) q(query_id), (VALUES (0, 7919), (1, 104729), (2, 611953)) l(list_idx, p)) WHERE rank0 < 20)"""


def _fused_sql(weight: str) -> str:
    return f"""{LISTS},
fused AS (
  SELECT query_id, file, sum({weight} / (60 + rank0 + 1)) AS base, min(rank0) AS best, min(list_idx * 1000 + rank0) AS place FROM lists GROUP BY query_id, file),
ranked AS (
  SELECT *, CASE WHEN best = 0 THEN 0.05 WHEN best <= 2 THEN 0.02 ELSE 0 END AS bonus,
    row_number() OVER (PARTITION BY query_id ORDER BY round(base + CASE WHEN best = 0 THEN 0.05 WHEN best <= 2 THEN 0.02 ELSE 0 END, 12) DESC, place) AS fused_rank FROM fused)"""


@query(f"WITH {_fused_sql('1.0')} SELECT query_id, file, round(base + bonus, 6) AS score, CAST(fused_rank AS INTEGER) AS fused_rank FROM ranked")
def rrf_fusion(spark, d):
    return fusion.fused_rank(fusion.fuse(lists(spark, d))).select("query_id", "file", F.round("score", 6).alias("score"), "fused_rank")


@query(f"""WITH {_fused_sql("(CASE query_type WHEN 'original' THEN 2.0 ELSE 1.0 END)")} SELECT query_id, file, round(base + bonus, 6) AS score, CAST(fused_rank AS INTEGER) AS fused_rank FROM ranked""")
def rrf_weighted(spark, d):
    weighted = lists(spark, d).withColumn("weight", fusion.hybrid_weight(F.col("query_type")))
    return fusion.fused_rank(fusion.fuse(weighted)).select("query_id", "file", F.round("score", 6).alias("score"), "fused_rank")


@query(f"WITH {_fused_sql('(CASE list_idx WHEN 0 THEN 2.0 ELSE 1.0 END)')} SELECT query_id, file, round(base, 6) AS base, CAST(bonus AS DOUBLE) AS bonus FROM ranked")
def rrf_bonus(spark, d):
    weighted = lists(spark, d).withColumn("weight", fusion.structured_weight(F.col("list_idx")))
    return fusion.fuse(weighted).select("query_id", "file", F.round("base", 6).alias("base"), "bonus")


@query(f"""WITH {LISTS} SELECT query_id, file, string_agg(list_idx || ':' || (rank0 + 1), ',' ORDER BY list_idx) AS places, count(*) AS n, CAST(min(rank0) + 1 AS INTEGER) AS best_rank,
  round(sum(1.0 / (61 + rank0)) + CASE WHEN min(rank0) = 0 THEN 0.05 WHEN min(rank0) <= 2 THEN 0.02 ELSE 0 END, 6) AS total FROM lists GROUP BY query_id, file""")
def rrf_trace(spark, d):
    t = fusion.trace(lists(spark, d))
    places = F.array_join(F.transform("contributions", lambda c: F.concat_ws(":", c["list_idx"].cast("string"), c["rank"].cast("string"))), ",")
    return t.select("query_id", "file", places.alias("places"), F.size("contributions").cast("long").alias("n"), "best_rank", F.round("total", 6).alias("total"))


@query(f"WITH {_fused_sql('1.0')} SELECT query_id, file, round(1.0 / fused_rank, 6) AS score FROM ranked WHERE fused_rank <= 40")
def skip_rerank_scores(spark, d):
    got = fusion.fused_rank(fusion.fuse(lists(spark, d))).where(F.col("fused_rank") <= fusion.CANDIDATES)
    return got.select("query_id", "file", F.round(1 / F.col("fused_rank"), 6).alias("score"))


@query(f"""WITH {_fused_sql('1.0')}, w AS (SELECT *, CASE WHEN fused_rank <= 3 THEN 0.75 WHEN fused_rank <= 10 THEN 0.60 ELSE 0.40 END AS w, (length(file) % 10) / 10.0 AS s FROM ranked WHERE fused_rank <= 40)
SELECT query_id, file, round(w / fused_rank + (1 - w) * s, 6) AS score FROM w""")
def blend_scores(spark, d):
    got = fusion.fused_rank(fusion.fuse(lists(spark, d))).where(F.col("fused_rank") <= fusion.CANDIDATES)
    return got.select("query_id", "file", F.round(fusion.blended(F.col("fused_rank"), (F.length("file") % 10) / 10), 6).alias("score"))


STRONG = "s AS (SELECT doc_id // 3 AS query_id, ((doc_id * 37) % 101) / 100.0 AS score FROM documents)"


@query(f"""WITH {STRONG}, r AS (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS n FROM s),
t AS (SELECT query_id, max(score) FILTER (n = 1) AS top, coalesce(max(score) FILTER (n = 2), 0.0) AS second FROM r GROUP BY query_id)
SELECT query_id, round(CAST(top AS DOUBLE), 6) AS top, round(CAST(second AS DOUBLE), 6) AS second, CAST(top AS DOUBLE) >= 0.85 AND CAST(top AS DOUBLE) - CAST(second AS DOUBLE) >= 0.15 AS strong FROM t""")
def strong_signal(spark, d):
    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 3).alias("query_id"), (((F.col("doc_id") * 37) % 101) / 100).alias("score"))
    return fusion.strong_signal(rows).select("query_id", F.round("top", 6).alias("top"), F.round("second", 6).alias("second"), "strong")


@query(f"WITH {LISTS} SELECT query_id, file, max(1.0 / (1 + rank0)) AS score FROM lists GROUP BY query_id, file")
def max_score_merge(spark, d):
    rows = lists(spark, d).select("query_id", "file", F.col("backend_score").alias("score"), F.col("rank0").alias("doc_id"))
    return ranking.best_of_file(rows, ["query_id", "file"]).select("query_id", "file", "score")


# lookup


@query(f"WITH {DOCS} SELECT path, CAST(levenshtein(lower(path), 'en/123.md') AS INTEGER) AS distance FROM docs WHERE levenshtein(lower(path), 'en/123.md') <= 5 ORDER BY distance, path LIMIT 5")
def similar_paths_levenshtein(spark, d):
    return lookup.similar(documents(spark, d), "en/123.md")


@query(f"""WITH {DOCS}, names AS (SELECT replace(substr(path, 2), '.md', 'm') AS name FROM docs WHERE doc_id % 40 = 0),
near AS (SELECT DISTINCT n.name, d.path, levenshtein(lower(n.name), lower(d.path)) AS distance FROM names n, docs d)
SELECT name, path, CAST(distance AS INTEGER) AS distance FROM near WHERE distance <= 3 QUALIFY row_number() OVER (PARTITION BY name ORDER BY distance, path) <= 5""")
def similar_name_set(spark, d):
    """A misspelt name of every fortieth document, all at once."""
    docs = documents(spark, d)
    names = docs.where("doc_id % 40 = 0").select(F.regexp_replace(F.expr("substr(path, 2)"), r"\.md", "m").alias("name"))
    return lookup.similar_names(docs, names, 3)


@query(f"WITH {DOCS} SELECT collection, path FROM docs WHERE regexp_full_match(path, 'en/1[^/]*\\.md') OR regexp_full_match(path, '(de|fr)/[^/]*7\\.md') OR regexp_full_match(collection || '/' || path, 'src4/.*')")
def glob_match(spark, d):
    return lookup.by_globs(documents(spark, d), "en/1*.md, {de,fr}/*7.md, src4/**").select("collection", "path")


@query(f"WITH {DOCS}, one AS (SELECT substr(hash, 1, 6) AS id FROM docs WHERE doc_id = 1) SELECT collection, path, hash FROM docs, one WHERE starts_with(hash, id) ORDER BY collection, path LIMIT 1")
def docid_lookup(spark, d):
    docs = documents(spark, d)
    return lookup.by_docid(docs, f"#{docs.where('doc_id = 1').first()['hash'][:6]}").select("collection", "path", "hash")


NAMED = ["src1/en/1.md", "2.md", "tarn://src3/fr/3.md", "nothing.md", "7.md"]


@query(f"""WITH {DOCS}, n(name, key) AS (VALUES ('src1/en/1.md', 'src1/en/1.md'), ('2.md', '2.md'), ('tarn://src3/fr/3.md', 'src3/fr/3.md'), ('nothing.md', 'nothing.md'), ('7.md', '7.md')),
m AS (SELECT name, collection, path, CASE WHEN collection || '/' || path = key THEN 1 WHEN path = key THEN 2 ELSE 3 END AS tier FROM n JOIN docs ON collection || '/' || path = key OR path = key OR path LIKE '%/' || key),
b AS (SELECT name, tier, count(*) AS k, min(collection || '/' || path) AS file FROM m GROUP BY name, tier QUALIFY row_number() OVER (PARTITION BY name ORDER BY tier) = 1)
SELECT n.name, CASE WHEN k IS NULL THEN 'missing' WHEN k > 1 THEN 'ambiguous' ELSE 'found' END AS status, coalesce(k, 0) AS n, CASE WHEN k = 1 THEN file END AS file FROM n LEFT JOIN b USING (name)""")
def comma_list_resolution(spark, d):
    got = lookup.resolve(documents(spark, d), spark.createDataFrame([(n,) for n in NAMED], "name string"))
    return got.select("name", "status", "n", F.when(F.col("status") == "found", F.concat_ws("/", "collection", "path")).alias("file"))


@query(f"""WITH {DOCS}, rules(collection, prefix, context) AS (VALUES ('src1', '/', 'root of one'), ('src1', '/en', 'English of one'), ('src2', '/de/', 'German of two'))
SELECT d.collection, d.path, 'overall' || coalesce(chr(10) || chr(10) || string_agg(context, chr(10) || chr(10) ORDER BY length(prefix)), '') AS context
FROM docs d LEFT JOIN rules r ON r.collection = d.collection AND starts_with('/' || d.path, r.prefix) GROUP BY d.collection, d.path""")
def path_context(spark, d):
    rules = spark.createDataFrame([("src1", "/", "root of one"), ("src1", "en", "English of one"), ("src2", "/de/", "German of two")], "collection string, prefix string, context string")
    return lookup.contexts(documents(spark, d).select("collection", "path"), rules, "overall")


@query(f"WITH {DOCS} SELECT doc_id, array_to_string(string_split(body, chr(10))[2:4], chr(10)) AS part FROM docs")
def line_slice(spark, d):
    return documents(spark, d).select("doc_id", T.line_slice(F.col("body"), 2, 3).alias("part"))


@query(f"WITH {DOCS}, l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS x, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM docs) SELECT doc_id, sha256(string_agg(i || ': ' || x, chr(10) ORDER BY i)) AS digest FROM l GROUP BY doc_id")
def add_line_numbers(spark, d):
    return documents(spark, d).select("doc_id", F.sha2(T.numbered(F.col("body")), 256).alias("digest"))


@query(f"""WITH {DOCS}, l AS (SELECT doc_id, lower(unnest(string_split(body, chr(10)))) AS x, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM docs),
s AS (SELECT doc_id, i, contains(x, 'the')::INT + contains(x, 'license')::INT AS s FROM l)
SELECT doc_id, CAST(min_by(i, -s * 1000000 + i) AS INTEGER) AS line FROM s GROUP BY doc_id""")
def best_line(spark, d):
    return documents(spark, d).select("doc_id", T.best_line(F.col("body"), ["the", "license"]).cast("int").alias("line"))


@query(f"WITH {DOCS} SELECT doc_id, CASE WHEN len(string_split(body, chr(10))) > 3 THEN array_to_string(string_split(body, chr(10))[1:3], chr(10)) || chr(10) || chr(10) || '[... truncated ' || (len(string_split(body, chr(10))) - 3) || ' more lines]' ELSE body END AS shown FROM docs")
def clipped_lines(spark, d):
    return documents(spark, d).select("doc_id", T.clipped(F.col("body"), 3).alias("shown"))


@query(r"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '# Title of ' || doc_id || chr(10) || coalesce(text, '') WHEN doc_id % 3 = 1 THEN '## Notes' || chr(10) || '## Second ' || doc_id || chr(10) ELSE coalesce(text, '') END AS doc FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Title of ' || doc_id WHEN 1 THEN 'Notes' ELSE CAST(doc_id AS VARCHAR) END AS title FROM p""")
def title_extract(spark, d):
    n = F.col("doc_id").cast("string")
    doc = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Title of "), n, F.lit("\n"), F.coalesce("text", F.lit("")))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("## Notes\n## Second "), n, F.lit("\n"))).otherwise(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", T.title(doc, F.concat(F.lit("en/"), n, F.lit(".md"))).alias("title"))


@query(f"WITH {DOCS} SELECT doc_id, 'tarn://' || collection || '/' || path AS file, substr(hash, 1, 6) AS docid, length(body) AS n_chars, octet_length(encode(body)) AS n_bytes FROM docs WHERE active")
def document_projection(spark, d):
    docs = maintenance.active(documents(spark, d))
    return docs.select("doc_id", P.virtual_path(F.col("collection"), F.col("path")).alias("file"), P.docid(F.col("hash")).alias("docid"), F.length("body").cast("long").alias("n_chars"), T.byte_length(F.col("body")).cast("long").alias("n_bytes"))


@query(f"WITH {DOCS} SELECT path, octet_length(encode(body)) AS size, modified_at FROM docs WHERE collection = 'src3' AND starts_with(path, 'en/')")
def list_files(spark, d):
    docs = documents(spark, d)
    return lookup.listing(docs, docs.groupBy("hash").agg(F.first("body").alias("doc")), "src3", "en/").withColumn("size", F.col("size").cast("long"))


@query(f"WITH {DOCS} SELECT path, length(body) > 3000 AS skipped, CASE WHEN length(body) > 3000 THEN 'File too large (' || CAST(round(length(body) / 1024.0) AS BIGINT) || 'KB)' END AS skip_reason FROM docs WHERE collection = 'src5'")
def multi_get_sizes(spark, d):
    docs = documents(spark, d)
    found = docs.where("collection = 'src5'").select("path", "hash")
    return lookup.with_bodies(found, docs.groupBy("hash").agg(F.first("body").alias("doc")), 3000).select("path", "skipped", "skip_reason")


# formats


def _results(spark, d):
    docs = documents(spark, d)
    return docs.select("doc_id", P.docid(F.col("hash")).alias("docid"), (F.col("doc_id") % 100 / 100).alias("score"), F.concat_ws("/", "collection", "path").alias("file"), F.concat(F.lit('a "title", '), F.col("title")).alias("title"), F.when(F.col("doc_id") % 2 == 0, 'say "x" & <y>').alias("context"), F.lit(3).alias("line"), F.col("body").alias("snippet"))


RESULTS = DOCS + """, res AS (SELECT doc_id, substr(hash, 1, 6) AS docid, (doc_id % 100) / 100.0 AS score, collection || '/' || path AS file, 'a "title", ' || title AS title,
  CASE WHEN doc_id % 2 = 0 THEN 'say "x" & <y>' END AS context, 3 AS line, body AS snippet FROM docs)"""


def _csv(x: str) -> str:
    return f"""(CASE WHEN regexp_matches(coalesce({x}, ''), '[,"\\n]') THEN '"' || replace({x}, '"', '""') || '"' ELSE coalesce({x}, '') END)"""


def _xml(x: str) -> str:
    return reduce(lambda s, p: f"replace({s}, {p[0]}, '{p[1]}')", (("'&'", "&amp;"), ("'<'", "&lt;"), ("'>'", "&gt;"), ("'\"'", "&quot;"), ("''''", "&apos;")), x)


@query(f"WITH {RESULTS} SELECT doc_id, '#' || docid || ',' || printf('%.4f', score) || ',' || {_csv('file')} || ',' || {_csv('title')} || ',' || {_csv('context')} || ',' || line || ',' || {_csv('snippet')} AS row FROM res")
def format_csv(spark, d):
    return _results(spark, d).select("doc_id", formatters.search_row("csv").alias("row"))


@query(f"""WITH {RESULTS} SELECT doc_id, '#' || docid || ',' || printf('%.2f', score) || ',' || file || coalesce(',"' || replace(context, '"', '""') || '"', '') AS row FROM res""")
def format_files(spark, d):
    return _results(spark, d).select("doc_id", formatters.search_row("files").alias("row"))


@query(f"""WITH {RESULTS} SELECT doc_id, '<file docid="#' || docid || '" name="' || {_xml('file')} || '" title="' || {_xml('title')} || '"' || coalesce(' context="' || {_xml('context')} || '"', '') || '>' || chr(10) || {_xml('snippet')} || chr(10) || '</file>' AS row FROM res""")
def format_xml(spark, d):
    return _results(spark, d).select("doc_id", formatters.search_row("xml").alias("row"))


@query(f"""WITH {RESULTS} SELECT doc_id, '---' || chr(10) || '# ' || title || chr(10) || chr(10) || '**file:** `' || file || '`' || chr(10) || '**docid:** `#' || docid || '`' || chr(10) || coalesce('**context:** ' || context || chr(10), '') || chr(10) || snippet || chr(10) AS row FROM res""")
def format_markdown(spark, d):
    return _results(spark, d).select("doc_id", formatters.search_row("md").alias("row"))


@query(f"""WITH {RESULTS} SELECT doc_id, '{{"docid":"#' || docid || '","score":' || CAST(CAST(score AS DOUBLE) AS VARCHAR) || ',"file":' || to_json(file) || ',"line":3,"title":' || to_json(title)
  || coalesce(',"context":' || to_json(context), '') || ',"snippet":' || to_json(snippet) || '}}' AS row FROM res""")
def format_json(spark, d):
    return _results(spark, d).select("doc_id", formatters.search_row("json").alias("row"))


@query(f"""WITH {RESULTS}
SELECT doc_id, sha256(row) AS row FROM (SELECT doc_id, {_csv("'#' || docid")} || ',' || {_csv('file')} || ',' || {_csv('title')} || ',' || CAST(CAST(score AS DOUBLE) AS VARCHAR) || ',' || {_csv('context')} || ',' || {_csv('snippet')} AS row FROM res)""")
def format_mcp_csv(spark, d):
    return _results(spark, d).select("doc_id", F.sha2(formatters.search_row("mcp"), 256).alias("row"))


@query(f"""WITH {DOCS}, r AS (SELECT doc_id, collection || '/' || path AS file, title, body, length(body) > 3000 AS skipped FROM docs)
SELECT doc_id,
  sha256('{{"file":' || to_json(file) || ',"title":' || to_json(title) || CASE WHEN skipped THEN ',"skipped":true,"reason":"large"}}' ELSE ',"body":' || to_json(body) || '}}' END) AS json,
  sha256({_csv('file')} || ',' || {_csv('title')} || ',,' || CAST(skipped AS VARCHAR) || ',' || CASE WHEN skipped THEN 'large' ELSE {_csv('body')} END) AS csv,
  sha256(file || CASE WHEN skipped THEN ',[SKIPPED]' ELSE '' END) AS files,
  sha256('## ' || file || chr(10) || chr(10) || '**Title:** ' || title || chr(10) || chr(10) || CASE WHEN skipped THEN '> large' || chr(10) ELSE '```' || chr(10) || body || chr(10) || '```' || chr(10) END) AS md,
  sha256('  <document>' || chr(10) || '    <file>' || {_xml('file')} || '</file>' || chr(10) || '    <title>' || {_xml('title')} || '</title>' || chr(10)
    || CASE WHEN skipped THEN '    <skipped>true</skipped>' || chr(10) || '    <reason>large</reason>' ELSE '    <body>' || {_xml('body')} || '</body>' END || chr(10) || '  </document>') AS xml
FROM r""")
def format_documents(spark, d):
    docs = documents(spark, d)
    rows = docs.select("doc_id", F.concat_ws("/", "collection", "path").alias("file"), "title", F.lit(None).cast("string").alias("context"), "body", (F.length("body") > 3000).alias("skipped"), F.lit("large").alias("skip_reason"))
    return rows.select("doc_id", *(F.sha2(formatters.document_row(f), 256).alias(f) for f in ("json", "csv", "files", "md", "xml")))


# metrics


def _runs(spark, d):
    files = lists(spark, d)
    results = files.where("list_idx < 2").select("query_id", F.col("query_type").alias("backend"), (F.col("rank0") + 1).alias("rank"), F.concat(F.lit("tarn://"), F.col("file")).alias("file"))
    expected = files.where("list_idx = 0 AND rank0 IN (1, 4, 30) OR list_idx = 2 AND rank0 < 2").select("query_id", F.regexp_replace("file", "^[^/]*/", "").alias("file")).distinct()
    return results, expected


METRICS = LISTS + """,
results AS (SELECT query_id, query_type AS backend, rank0 + 1 AS rank, lower(regexp_replace(file, '^[^/]*/', '')) AS file FROM lists WHERE list_idx < 2),
expected AS (SELECT DISTINCT query_id, regexp_replace(file, '^[^/]*/', '') AS file FROM lists WHERE list_idx = 0 AND rank0 IN (1, 4, 30) OR list_idx = 2 AND rank0 < 2),
firsts AS (
  SELECT e.query_id, b.backend, e.file, min(CASE WHEN r.file = lower(e.file) OR ends_with(r.file, lower(e.file)) OR ends_with(lower(e.file), r.file) THEN r.rank END) AS best
  FROM expected e, (VALUES ('original'), ('lex')) b(backend), results r WHERE r.query_id = e.query_id AND r.backend = b.backend GROUP BY e.query_id, b.backend, e.file),
m AS (
  SELECT query_id, backend, count(*) AS total_expected, count(*) FILTER (best <= 5) AS hits_at_k, count(*) FILTER (best <= 5) / least(5, count(*)) AS precision_at_k, count(best) / count(*) AS recall,
    count(*) FILTER (best <= 1) / count(*) AS recall_at_1, count(*) FILTER (best <= 3) / count(*) AS recall_at_3, count(*) FILTER (best <= 5) / count(*) AS recall_at_5, coalesce(1 / min(best), 0) AS mrr
  FROM firsts GROUP BY query_id, backend),
metrics AS (SELECT *, CASE WHEN precision_at_k + recall > 0 THEN 2 * precision_at_k * recall / (precision_at_k + recall) ELSE 0 END AS f1 FROM m)"""
MEASURES = ("precision_at_k", "recall", "recall_at_1", "recall_at_3", "recall_at_5", "mrr", "f1")


@query(f"WITH {METRICS} SELECT query_id, backend, total_expected, hits_at_k, {', '.join(f'round(CAST({m} AS DOUBLE), 6) AS {m}' for m in MEASURES)} FROM metrics")
def precision_recall_mrr(spark, d):
    m = evaluation.retrieval_metrics(*_runs(spark, d), 5)
    return m.select("query_id", "backend", "total_expected", "hits_at_k", *(F.round(x, 6).alias(x) for x in MEASURES))


@query(f"WITH {METRICS} SELECT backend, {', '.join(f'round(avg({m}), 6) AS {m}' for m in MEASURES)}, count(*) AS n_queries, false AS all_zero FROM metrics GROUP BY backend")
def retrieval_summary(spark, d):
    s = evaluation.summary(evaluation.retrieval_metrics(*_runs(spark, d), 5))
    return s.select("backend", *(F.round(x, 6).alias(x) for x in MEASURES), "n_queries", "all_zero")


@query(f"""WITH {METRICS}, wanted AS (SELECT query_id, min(file) AS doc, CASE WHEN query_id % 2 = 0 THEN 'easy' ELSE 'hard' END AS difficulty FROM expected GROUP BY query_id),
h AS (SELECT w.query_id, difficulty, max(CASE WHEN rank <= 3 AND contains(r.file, lower(doc)) THEN 1 ELSE 0 END) AS hit FROM wanted w JOIN results r USING (query_id) WHERE backend = 'original' GROUP BY w.query_id, difficulty)
SELECT difficulty, count(*) AS n, round(avg(hit), 6) AS hit_rate FROM h GROUP BY difficulty""")
def hit_rate(spark, d):
    results, expected = _runs(spark, d)
    wanted = expected.groupBy("query_id").agg(F.min("file").alias("expected_doc")).withColumn("difficulty", F.when(F.col("query_id") % 2 == 0, "easy").otherwise("hard"))
    return evaluation.hit_rate(results.where("backend = 'original'"), wanted, 3).withColumn("hit_rate", F.round("hit_rate", 6))


def _typed(spark, d, offset: int):
    """Three expansions of each type of every benchmark item, cut out of its words from an offset on."""
    words = F.split("text", " ")
    part = lambda t, k: F.struct(F.lit(t).alias("type"), F.lit(k).alias("no"), F.array_join(F.slice(words, 1 + offset + 4 * k, 6 if t == "lex" else 12), " ").alias("text"))
    every = F.array(*(part(t, k) for t in ("lex", "vec", "hyde") for k in range(3)))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(every).alias("x")).select("query_id", "x.*")


def _typed_sql(name: str, offset: int) -> str:
    return f"""{name} AS (SELECT item_id AS query_id, type, no, array_to_string(string_split(text, ' ')[{1 + offset} + 4 * no : {offset} + 4 * no + CASE type WHEN 'lex' THEN 6 ELSE 12 END], ' ') AS text
  FROM benchmark, (VALUES ('lex'), ('vec'), ('hyde')) t(type), range(3) r(no))"""


STOPS = ", ".join(f"'{w}'" for w in evaluation.STOP_WORDS)


def _set(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS})))"


MATCHES = f"""{_typed_sql('pred', 0)}, {_typed_sql('gold', 2)},
pairs AS (SELECT p.query_id, p.type, p.no AS pred_no, g.no AS golden_no, {_set('p.text')} AS a, {_set('g.text')} AS b FROM pred p JOIN gold g ON p.query_id = g.query_id AND p.type = g.type),
sims AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS s FROM pairs),
tops AS (SELECT query_id, type, pred_no, golden_no, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id, type, pred_no ORDER BY s DESC, golden_no) AS r FROM sims) WHERE r = 1),
matched AS (SELECT query_id, type, pred_no, CASE WHEN s > 0 AND s >= CASE type WHEN 'lex' THEN 0.5 WHEN 'vec' THEN 0.35 ELSE 0.25 END THEN golden_no END AS golden_no, s FROM tops)"""


@query(f"WITH {MATCHES} SELECT query_id, type, pred_no, CAST(coalesce(golden_no, -1) AS INTEGER) AS golden_no, round(CAST(s AS DOUBLE), 6) AS similarity FROM matched")
def jaccard_match(spark, d):
    return evaluation.expansion_matches(_typed(spark, d, 0), _typed(spark, d, 2)).withColumns({"golden_no": F.coalesce("golden_no", F.lit(-1)), "similarity": F.round("similarity", 6)})


@query(f"""WITH {MATCHES}, t AS (SELECT type, count(*) AS pred_count, count(golden_no) AS matched, count(DISTINCT CASE WHEN golden_no IS NOT NULL THEN query_id * 10 + golden_no END) AS gm FROM matched GROUP BY type),
n AS (SELECT type, count(*) AS golden_count FROM gold GROUP BY type), j AS (SELECT type, pred_count, golden_count, matched, gm FROM t JOIN n USING (type)),
u AS (SELECT * FROM j UNION ALL SELECT 'overall', sum(pred_count), sum(golden_count), sum(matched), sum(matched) FROM j),
pr AS (SELECT *, matched / pred_count AS p, gm / golden_count AS r FROM u)
SELECT type, CAST(pred_count AS BIGINT) AS pred_count, CAST(golden_count AS BIGINT) AS golden_count, CAST(matched AS BIGINT) AS matched, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr""")
def expansion_prf(spark, d):
    m = evaluation.expansion_metrics(_typed(spark, d, 0), _typed(spark, d, 2))
    return m.select("type", "pred_count", "golden_count", "matched", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


CONV = "c AS (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user' AND text IS NOT NULL)"


def _conversations(spark, d):
    return table(spark, d, "conversations").where("role = 'user' AND text IS NOT NULL").select("conv_id", "turn", F.col("text").alias("query"))


@query(f"WITH {CONV} SELECT conv_id, turn, query FROM c QUALIFY row_number() OVER (PARTITION BY lower(trim(query, ' ')) ORDER BY conv_id, turn) = 1")
def query_dedup(spark, d):
    return evaluation.distinct_queries(_conversations(spark, d), ["conv_id", "turn"])


@query(rf"""WITH {CONV}, w AS (SELECT *, len(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda x: x <> '')) AS n FROM c)
SELECT CASE WHEN n <= 2 THEN 'short_keyword' WHEN regexp_matches(query, '(^|\s)\p{{Lu}}') THEN 'named_entity' WHEN regexp_matches(lower(query), '{"|".join(expansion.TEMPORAL)}') THEN 'temporal'
  WHEN starts_with(lower(query), 'how ') THEN 'how_to' WHEN starts_with(lower(query), 'what ') THEN 'what_is' WHEN regexp_matches(lower(query), '{"|".join(expansion.COMPARISON)}') THEN 'comparison'
  WHEN regexp_matches(lower(query), '{"|".join(expansion.PERSONAL)}') THEN 'personal' ELSE 'other' END AS category, count(*) AS n FROM w GROUP BY ALL""")
def query_categories(spark, d):
    return expansion.categories(_conversations(spark, d))


@query("SELECT doc_id, count(*) AS n, median(x) AS median FROM (SELECT doc_id % 50 AS doc_id, n_chars AS x FROM documents) GROUP BY doc_id")
def median_timings(spark, d):
    return table(spark, d, "documents").groupBy((F.col("doc_id") % 50).alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.median("n_chars").alias("median"))


def _in(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _rubric_sql() -> str:
    """The rubric of expansions of all types, said in SQL from its rules."""
    bare = lambda w: rf"regexp_replace(regexp_replace({w}, '^[.,!?:;()\[\]\"'']+', ''), '[.,!?:;()\[\]\"'']+$', '')"
    words = lambda x: rf"list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda w_: w_ <> '')"
    apart = lambda a, b: f"(NOT contains({a}, {b}) AND NOT contains({b}, {a}) AND len(list_distinct({words(a)})) + len(list_distinct({words(b)})) - 2 * len(list_intersect({words(a)}, {words(b)})) >= least)"
    pairs = ((1, 2), (1, 3), (2, 3))
    copies = lambda k: " + ".join(f"CASE WHEN {apart(f'lower({k}[{i}])', f'lower({k}[{j}])')} THEN 0 ELSE 1 END" for i, j in pairs)
    echoes = lambda k: f"len(list_filter({k}, lambda x: contains(lower(x), lower(q)) AND (lower(x) = lower(q) OR length(x) < length(q) + 10)))"
    generic = []
    for phrase in expansion.GENERIC:
        rest = "lower(x)"
        for w in phrase.split():
            rest = f"trim(regexp_replace({rest}, '{w}', ''))"
        generic.append(f"((contains(lower(x), '{phrase}') OR starts_with(lower(x), '{phrase.split()[0]}')) AND length({rest}) < 3)")
    kept = lambda test, every, some, none: f"CASE WHEN len(list_filter(lex, lambda x: {test})) = 3 THEN {every} WHEN len(list_filter(lex, lambda x: {test})) > 0 THEN {some} ELSE {none} END"
    named = "len(list_filter(names, lambda m: contains(lower(x), m))) > 0"
    cut = lambda n: f"[trim(array_to_string(w[1:{n}], ' ')), trim(array_to_string(w[5:{n + 4}], ' ')), trim(array_to_string(w[9:{n + 8}], ' '))]"
    return rf"""WITH w AS (SELECT item_id, string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS w FROM benchmark),
x AS (SELECT item_id AS query_id, array_to_string(w[1:5], ' ') AS q, {cut(6)} AS lex, {cut(12)} AS vec, {cut(12)}[1] AS hyde FROM w),
b AS (SELECT *, CASE WHEN len({words('q')}) >= 5 THEN 3 ELSE 2 END AS least, list_transform(list_filter(regexp_split_to_array(q, '\s+'), lambda y: y <> ''), lambda y: {bare('y')}) AS bare FROM x),
n AS (SELECT *, list_transform(bare, lambda y, i: CASE WHEN length(y) > 1 AND upper(y) = y AND lower(y) <> y THEN true
    WHEN regexp_matches(y, '^\p{{Lu}}') AND NOT list_contains({_in(sorted(expansion.KEY_STOP_WORDS))}, lower(y)) THEN i > 1 OR NOT list_contains({_in(sorted(expansion.FIRST_WORDS))}, lower(y))
    ELSE (length(y) > 1 AND regexp_matches(y, '[.+#@-]')) OR regexp_matches(y, '^\p{{Lu}}.*\p{{Lu}}') END) AS named FROM b),
e AS (SELECT *, list_sort(list_distinct(list_transform(list_filter(range(1, len(bare) + 1), lambda i: named[i] OR (i > 1 AND named[i - 1] AND bare[i] <> '' AND NOT list_contains({_in(sorted(expansion.KEY_STOP_WORDS))}, lower(bare[i])))), lambda i: lower(bare[i])))) AS names,
    list_filter({words('q')}, lambda y: NOT list_contains({_in(sorted(expansion.KEY_STOP_WORDS))}, y)) AS terms, {echoes('lex')} AS lex_echoes, {echoes('vec')} AS vec_echoes FROM n),
r AS (SELECT *, regexp_extract_all(lower(hyde), '[\p{{L}}\p{{N}}_]+') AS hw FROM e),
p AS (SELECT query_id, names, lex_echoes, 30 + 15 + greatest(0, 5 - 2 * ({copies('lex')})) + greatest(0, 5 - 2 * ({copies('vec')})) + greatest(-10, 5 - 10 * lex_echoes - 3 * vec_echoes)
  + 10 + CASE WHEN length(hyde) BETWEEN 50 AND 200 THEN 5 WHEN length(hyde) < 50 THEN 2 ELSE 0 END
  + greatest(0, 5 - coalesce(list_sum(list_transform(list_filter(list_distinct(hw), lambda y: length(y) > 2 AND NOT list_contains({_in(expansion.REPEAT_STOP_WORDS)}, y)), lambda y: greatest(0, 2 * (len(list_filter(hw, lambda z: z = y)) - 2)))), 0))
  + 5 + CASE WHEN list_sum(list_transform(lex, lambda y: length(y))) <= list_sum(list_transform(vec, lambda y: length(y))) THEN 5 ELSE 0 END
  + CASE WHEN len(list_filter(vec, lambda y: contains(y, ' ') AND length(y) > 15)) = 3 THEN 5 ELSE 2 END
  + {kept(f"len(terms) = 0 OR list_has_any(terms, {words('x')})", 5, 2, 0)} - 3 * len(list_filter(lex, lambda x: len(list_filter({_in(sorted(expansion.FILLER))}, lambda f: list_contains({words('x')}, f) AND NOT list_contains({words('q')}, f))) > 0))
  + CASE WHEN len({words('q')}) >= 2 AND len(list_filter(lex, lambda x: contains(x, '"'))) > 0 THEN 3 ELSE 0 END
  + CASE WHEN len(names) = 0 THEN 10 ELSE {kept(named, 15, 5, -30)} - 20 * len(list_filter(names, lambda m: NOT contains(lower(array_to_string(list_concat(lex, vec), ' ')), m)))
      - 15 * len(list_filter(lex, lambda x: {' OR '.join(generic)})) + CASE WHEN len(list_filter(vec, lambda x: {named})) > 0 THEN 5 ELSE 0 END END
  + 20 AS raw FROM r),
s AS (SELECT *, least(CASE WHEN lex_echoes > 0 THEN 50.0 ELSE 100.0 END, greatest(0.0, raw / 140 * 100)) AS share FROM p)
SELECT query_id, CAST(greatest(0, raw) AS INTEGER) AS total, 140 AS max_possible, round(CAST(share AS DOUBLE), 1) AS percentage,
  CASE WHEN share >= 80 THEN 'Excellent' WHEN share >= 60 THEN 'Good' WHEN share >= 40 THEN 'Acceptable' WHEN share >= 20 THEN 'Poor' ELSE 'Failed' END AS rating, array_to_string(names, ',') AS entities FROM s"""


def _expansions(spark, d):
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    part = lambda n, k: F.array_join(F.slice(words, 1 + 4 * k, n), " ")
    lines = [F.concat(F.lit(f"{t}: "), part(6 if t == "lex" else 12, k)) for t in ("lex", "vec", "hyde") for k in range(3)]
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), part(5, 0).alias("query"), F.array_join(F.array(*lines), "\n").alias("expansion"))
    return expansion.rubric(rows)


@query(f"SELECT rating, count(*) AS n, round(avg(percentage), 4) AS mean_percentage FROM ({_rubric_sql()}) GROUP BY rating")
def score_distribution(spark, d):
    return expansion.score_distribution(_expansions(spark, d)).withColumn("mean_percentage", F.round("mean_percentage", 4))


@query(_rubric_sql())
def rubric_score(spark, d):
    return _expansions(spark, d).select("query_id", "score.total", "score.max_possible", "score.percentage", "score.rating", F.array_join("score.entities", ",").alias("entities"))


@query(rf"""WITH {CONV}, w AS (SELECT query, list_filter(regexp_split_to_array(query, '\s+'), lambda x: x <> '') AS w FROM c),
n AS (SELECT *, len(w) AS n, list_filter(w, lambda x: length(x) > 1 AND NOT list_contains(string_split('the a an is are to for of in and or', ' '), lower(x)) AND regexp_matches(x, '^\p{{Lu}}|[.+0-9-]')) AS e FROM w)
SELECT count(*) AS total, count(*) FILTER (n <= 2) AS short_queries, count(*) FILTER (n BETWEEN 3 AND 5) AS medium_queries, count(*) FILTER (n > 5) AS long_queries,
  count(*) AS has_lex, CAST(0 AS BIGINT) AS has_vec, count(*) AS has_hyde, count(*) FILTER (4 * length(query) > 200) AS long_hyde, count(*) FILTER (len(e) > 0) AS named_entity_queries,
  count(DISTINCT lower(query)) AS distinct_queries, count(*) - count(DISTINCT lower(query)) AS duplicate_queries FROM n""")
def expansion_statistics(spark, d):
    pairs = F.array(F.struct(F.lit("lex").alias("type"), F.col("query").alias("text")), F.struct(F.lit("hyde").alias("type"), F.repeat("query", 4).alias("text")))
    return expansion.statistics(_conversations(spark, d).withColumn("output", pairs))


# chunks, snippets and whole searches


@query()
def chunk_documents(spark, d):
    return chunk_rows(content(spark, d)).select("hash", "seq", "pos", F.length("text").alias("n_chars"), "tokens", "total_chunks")


@query(f"""WITH {DOCS}, l AS (SELECT doc_id, string_split(body, chr(10)) AS rows FROM docs),
s AS (SELECT *, list_transform(rows, lambda x: contains(lower(x), 'the')::INT + contains(lower(x), 'license')::INT) AS s FROM l),
b AS (SELECT *, list_position(s, list_max(s)) AS best FROM s),
t AS (SELECT *, greatest(1, best - 1) AS first, rows[greatest(1, best - 1) : best + 2] AS shown FROM b),
x AS (SELECT *, array_to_string(shown, chr(10)) AS x, len(rows) - (first + len(shown) - 1) AS after FROM t)
SELECT doc_id, CAST(best AS INTEGER) AS line, '@@ -' || first || ',' || len(shown) || ' @@ (' || (first - 1) || ' before, ' || after || ' after)' || chr(10) || CASE WHEN length(x) > 500 THEN substr(x, 1, 497) || '...' ELSE x END AS snippet,
  CAST(first - 1 AS INTEGER) AS lines_before, CAST(after AS INTEGER) AS lines_after, CAST(len(shown) AS INTEGER) AS snippet_lines FROM x""")
def extract_snippet(spark, d):
    return documents(spark, d).select("doc_id", snippets(F.col("body"), F.lit("the license")).alias("s")).select("doc_id", "s.*")


@query()
def embed_documents(spark, d):
    e = providers.HashEmbedder(16)

    embed = by_pieces("array<double>", pa.list_(pa.float64()), e.embed)
    return chunk_rows(content(spark, d)).select("hash", "seq", F.transform(embed(F.col("text")), lambda x: F.round(x, 6)).alias("embedding"))


@contextmanager
def _index(spark, d):
    """The index of a request, whose rows are collected within: texts are hashed once, and their hashes kept beside what tells of them till then."""
    told = documents(spark, d).drop("body").persist()
    try:
        yield search.Index(maintenance.active(told), content(spark, d), scan(spark, d), chunks(spark, d, told))
    finally:
        told.unpersist()


def _models() -> search.Models:
    return search.Models(providers.HashEmbedder(64), providers.PlainExpander(), providers.OverlapReranker())


ASKED = [(0, "apache license version"), (1, '"licensed under"'), (2, "the and")]


def _vector_of(k: int) -> str:
    return f"(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {k})"


def _hybrid_sql() -> str:
    """Lists of three queries by keywords and by vectors, fused, the best line of each candidate, blended with a score that the file's name gives."""
    keyword = " UNION ALL ".join(f"""SELECT {k} AS query_id, 0 AS list_idx, collection || '/' || path AS file, hash, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) - 1 AS rank0
  FROM ({lex_sql(q, 'SELECT doc_id, collection, path, hash, found.score FROM found JOIN docs USING (doc_id) ORDER BY round(found.score, 12) DESC, doc_id LIMIT 20')})""" for k, q in ASKED)
    meant = " UNION ALL ".join(f"""SELECT {k} AS query_id, 1 AS list_idx, file, hash, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) - 1 AS rank0
  FROM (SELECT docs.doc_id, collection || '/' || path AS file, docs.hash, max(1 - list_cosine_distance(embedding, {_vector_of(k)})) AS score
    FROM chunks JOIN docs ON docs.hash = chunks.hash GROUP BY ALL ORDER BY round(score, 12) DESC, docs.doc_id LIMIT 20)""" for k, _ in ASKED)
    words = ", ".join(f"({k}, {[w for w in q.lower().split() if len(w) > 2]})" for k, q in ASKED)
    held = "list_sum(list_transform(words, lambda w: CAST(contains(lower(line), w) AS INTEGER)))"
    return f"""WITH {CHUNKS},
lists AS (SELECT *, 2.0 AS weight FROM ({keyword} UNION ALL {meant})),
fused AS (SELECT query_id, file, min(hash) AS hash, sum(weight / (61 + rank0)) + CASE WHEN min(rank0) = 0 THEN 0.05 WHEN min(rank0) <= 2 THEN 0.02 ELSE 0 END AS score, min(list_idx * 1000 + rank0) AS place FROM lists GROUP BY query_id, file),
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, place) AS fused_rank FROM fused QUALIFY fused_rank <= 40),
words(query_id, words) AS (VALUES {words}),
bodies AS (SELECT DISTINCT hash, body FROM docs),
cut AS (SELECT hash, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS seq FROM bodies),
best AS (SELECT s.query_id, s.file, arg_min(c.seq, ({held.replace("words", "w.words")}) * -100000 + c.seq) AS seq FROM cand s JOIN words w USING (query_id) JOIN cut c ON c.hash = s.hash GROUP BY ALL),
given AS (SELECT s.*, best.seq, CASE WHEN fused_rank <= 3 THEN 0.75 WHEN fused_rank <= 10 THEN 0.6 ELSE 0.4 END AS w, (length(s.file) % 10) / 10 AS given FROM cand s JOIN best ON best.query_id = s.query_id AND best.file = s.file)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(w / fused_rank + (1 - w) * given, 12) DESC, fused_rank) AS INTEGER) AS rank, file, round(w / fused_rank + (1 - w) * given, 6) AS score, CAST(fused_rank AS INTEGER) AS fused_rank, CAST(seq AS INTEGER) AS seq
FROM given QUALIFY rank <= 10"""


@query(_hybrid_sql())
def hybrid_query_set(spark, d):
    docs = documents(spark, d)
    queries = spark.createDataFrame(ASKED, "query_id long, query string")
    asked = table(spark, d, "embeddings").where(F.col("vec_id") < len(ASKED)).select(F.col("vec_id").alias("query_id"), "embedding")
    found = batch.keyword_lists(scan(spark, d), docs, ASKED).unionByName(batch.vector_lists(chunks(spark, d), docs, asked))
    given = lambda rows: rows.withColumn("rerank_score", (F.length("file") % 10) / 10)
    got = batch.ranked(found, queries, docs.select("hash", F.col("body").alias("doc")).dropDuplicates(["hash"]), given, chunks_of=batch.lines)
    return got.select("query_id", "rank", "file", F.round("score", 6).alias("score"), "fused_rank", "seq")


def _found(spark, rows: list[search.Found]) -> DataFrame:
    return spark.createDataFrame([(x.file, round(x.score, 6), x.docid, x.best_chunk_pos) for x in rows], "file string, score double, docid string, best_chunk_pos int")


@query()
def hybrid_search(spark, d):
    with _index(spark, d) as index:
        return _found(spark, search.hybrid(spark, index, _models(), "apache license version"))


@query()
def retrieval_benchmark(spark, d):
    """Four backends on three queries of a fixture."""
    fixture = Fixture([FixtureQuery("phrase", '"mit license"', ["en/1.md"], 5), FixtureQuery("typed", 'lex: apache\nvec: works under a license', ["md"], 5), FixtureQuery("plain", "general public license", ["nowhere.md"], 3)])
    with _index(spark, d) as index:
        return run_fixture(spark, index, _models(), fixture).drop("latency_ms")


@query()
def structured_search(spark, d):
    typed = [TypedQuery("vec", "works under a license"), TypedQuery("lex", '"mit license"'), TypedQuery("hyde", "released under the MIT license")]
    with _index(spark, d) as index:
        return _found(spark, search.structured(spark, index, _models(), typed, intent="license notes"))


@query()
def vector_search_query(spark, d):
    with _index(spark, d) as index:
        return _found(spark, search.by_meaning(index, _models(), "released under the license", least=-1.0))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
