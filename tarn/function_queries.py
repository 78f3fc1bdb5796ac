"""Queries over the given tables for the engine's column functions, each with its SQL.

Paths, names and times are made from a document's number, language and source; the
SQL says what must come out of them, where it can by another way than the function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import paths as P
from tarn.functions import text as T
from tarn.operators import batching, code, evaluation, expansion, formatters, fusion, lookup, maintenance
from tarn.plans import lexquery
from tarn.retrieval_queries import DOCS, documents, query, table
from tarn.sources.snapshots import Warehouse


def rows(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, n (it as text), lang, source."""
    return table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("n"), "lang", "source")


ROWS = "r AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS n, lang, source FROM documents)"


def _one_of(*kinds):
    """The kind (a list of columns and texts) whose turn it is by the document's number."""
    out = F.lit(None).cast("string")
    for k, parts in enumerate(kinds):
        whole = F.concat(*(p if not isinstance(p, str) else F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts))
        out = F.when(F.col("doc_id") % len(kinds) == k, whole).otherwise(out)
    return out


def _one_of_sql(*kinds) -> str:
    text = lambda p: p[1:] if p.startswith("$") else "'" + p.replace("'", "''") + "'"
    return f"CASE doc_id % {len(kinds)} " + " ".join(f"WHEN {k} THEN {' || '.join(map(text, parts))}" for k, parts in enumerate(kinds)) + " END"


# paths


@query(f"""WITH {ROWS} SELECT doc_id, 'My-Notes/' || lang || '-v' || (doc_id % 5) || '/Plan-1f389-' || n || '.MD' AS slug, '1f389-' || lang || '.md' AS picture FROM r""")
def path_slugs(spark, d):
    """Folders by triple underscores, dashes for signs, emoji as code points, the extension kept."""
    long = F.concat(F.lit("My Notes/"), F.col("lang"), F.lit(" (v"), (F.col("doc_id") % 5).cast("string"), F.lit(")___Plan \N{PARTY POPPER}  & "), F.col("n"), F.lit(".MD"))
    return rows(spark, d).select("doc_id", P.slug(long).alias("slug"), P.slug(F.concat(F.lit("\N{PARTY POPPER} "), F.col("lang"), F.lit(".md"))).alias("picture"))


SPELLINGS = (("/data/notes/", "$lang", "/", "$n", ".md"), ("C:\\data\\", "$lang", "\\", "$n", ".md"), ("~/", "$n", ".md"), ("$lang", "/", "$n", ".md"), ("/data/notes2/", "$n", ".md"))


@query(f"""WITH {ROWS}, p AS (SELECT *, {_one_of_sql(*SPELLINGS)} AS path FROM r)
SELECT doc_id, array_to_string(string_split(path, chr(92)), '/') AS slashed, doc_id % 5 <> 3 AS absolute, CASE WHEN doc_id % 5 = 0 THEN lang || '/' || n || '.md' END AS relative,
  'en/' || n || '.md' AS comparable, lang = 'en' AS same FROM p""")
def path_forms(spark, d):
    """Separators, absolute paths, paths below a root, and the form in which paths are compared."""
    path, en = _one_of(*SPELLINGS), F.concat(F.lit("tarn://src/EN/"), F.col("n"), F.lit(".md"))
    return rows(spark, d).select(
        "doc_id", P.slashes(path).alias("slashed"), P.is_absolute(path).alias("absolute"), P.relative_to(path, F.lit("/data/notes/")).alias("relative"),
        P.comparable(en).alias("comparable"), P.same_file(en, F.concat(F.lit("/deep/"), F.col("lang"), F.lit("/"), F.col("n"), F.lit(".md/"))).alias("same"),
    )


@query(f"WITH {ROWS} SELECT doc_id, lang || '/a%20b%20(%C3%A9)%26%25/' || n || '~!*%2B.md' AS encoded FROM r")
def encoded_paths(spark, d):
    """Percent-encoding of each segment."""
    return rows(spark, d).select("doc_id", P.encoded_path(F.concat(F.col("lang"), F.lit("/a b (é)&%/"), F.col("n"), F.lit("~!*+.md"))).alias("encoded"))


@query(f"WITH {ROWS} SELECT doc_id, doc_id % 4 < 2 AS valid FROM r")
def collection_names(spark, d):
    """Which names a collection can have."""
    return rows(spark, d).select("doc_id", P.valid_collection_name(_one_of(("$lang", "-", "$n"), ("A_", "$n"), ("$lang", "/", "$n"), ("a b",))).alias("valid"))


PLACES = (("src/node_modules/x/", "$n", ".md"), ("$lang", "/", "$n", ".md"), ("notes/.hidden-", "$n", ".md"), ("distance/", "$n", ".md"), ("$lang", "/", "$n", ".txt"), (".git/", "$n", ".md"), ("a/dist/", "$n", ".md"), ("drafts/", "$n", ".txt"), ("x/", "$n", ".tmp.md"))


@query(f"""WITH {ROWS}, p AS (SELECT *, {_one_of_sql(*PLACES)} AS path FROM r), s AS (SELECT *, string_split(path, '/') AS s FROM p)
SELECT doc_id, list_has_any(s[1 : len(s) - 1], ['node_modules', '.git', '.cache', 'vendor', 'dist', 'build']) OR len(list_filter(s, lambda x: starts_with(x, '.'))) > 0 AS excluded,
  len(list_filter(s, lambda x: starts_with(x, '.'))) = 0 AND (ends_with(path, '.md') OR (len(s) = 2 AND s[1] IN ('en', 'de') AND ends_with(path, '.txt'))) AS in_mask,
  CASE WHEN s[1] = 'drafts' THEN 'drafts/**' WHEN ends_with(path, '.tmp.md') THEN '**/*.tmp.md' WHEN contains(path, '/.hidden') THEN '**/.hidden-*' END AS rule FROM s""")
def scan_rules(spark, d):
    """Folders that a scan never enters, the globs of a mask, and the ignore rule that hides a path."""
    path = _one_of(*PLACES)
    return rows(spark, d).select(
        "doc_id", P.excluded(path).alias("excluded"), P.matches_globs(path, P.split_globs("**/*.md, {en,de}/*.txt")).alias("in_mask"),
        lookup.ignored(path, ["drafts/**", "**/*.tmp.md", "**/.hidden-*"]).alias("rule"),
    )


ENDINGS = "ts mts tsx jsx js cjs py go rs md TS txt".split()


@query(f"""WITH {ROWS} SELECT doc_id, (['typescript', 'typescript', 'tsx', 'tsx', 'javascript', 'javascript', 'python', 'go', 'rust', NULL, 'typescript', NULL])[doc_id % 12 + 1] AS language FROM r""")
def detected_languages(spark, d):
    """Programming language by extension."""
    return rows(spark, d).select("doc_id", P.language_of(_one_of(*(("$lang", "/", "$n", f".{e}") for e in ENDINGS))).alias("language"))


@query(f"""WITH {ROWS}, p AS (SELECT doc_id, {_one_of_sql(*SPELLINGS)} AS path FROM r), c(name, root) AS (VALUES ('all', '/data'), ('notes', '/data/notes'), ('english', '/data/notes/en/'))
SELECT p.doc_id, max_by(name, length(root)) AS collection FROM p LEFT JOIN c ON starts_with(path, rtrim(root, '/') || '/') GROUP BY p.doc_id""")
def detected_collections(spark, d):
    """The collection whose root is the longest that a path is below."""
    roots = [("all", "/data"), ("notes", "/data/notes"), ("english", "/data/notes/en/")]
    return rows(spark, d).select("doc_id", lookup.collection_of(_one_of(*SPELLINGS), roots).alias("collection"))


@query(f"WITH {DOCS} SELECT doc_id, path FROM docs WHERE active AND doc_id > 17 ORDER BY doc_id LIMIT 500")
def keyset_page(spark, d):
    """The page of documents after a known one."""
    return maintenance.page(documents(spark, d), "doc_id", 17).select("doc_id", "path")


# numbers and times

TENTH = "printf('%.1f', floor({} * 10 + 0.5) / 10)"


@query(f"""WITH {DOCS}, t AS (SELECT doc_id, 5184000 - 60 * doc_id AS s, doc_id * doc_id * 1031 AS b FROM docs)
SELECT doc_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END || ' ago' AS age, CAST(s // 86400 AS INTEGER) AS days,
  CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN {TENTH.format('(b / 1024)')} || ' KB' WHEN b < 1073741824 THEN {TENTH.format('(b / 1048576)')} || ' MB' ELSE {TENTH.format('(b / 1073741824)')} || ' GB' END AS size,
  CASE WHEN doc_id < 1000 THEN doc_id || 'ms' ELSE {TENTH.format('(doc_id / 1000)')} || 's' END AS took,
  CASE WHEN doc_id * 7.5 < 60 THEN CAST(floor(doc_id * 7.5 + 0.5) AS BIGINT) || 's' WHEN doc_id * 7.5 < 3600 THEN CAST(floor(doc_id * 7.5 / 60) AS BIGINT) || 'm ' || CAST(floor(doc_id * 7.5 % 60 + 0.5) AS BIGINT) || 's'
    ELSE CAST(floor(doc_id * 7.5 / 3600) AS BIGINT) || 'h ' || CAST(floor(doc_id * 7.5 % 3600 / 60) AS BIGINT) || 'm' END AS left_over FROM t""")
def readable_numbers(spark, d):
    """Ages, days, sizes, durations and what is left of them as people read them."""
    now, id_ = F.timestamp_seconds(F.lit(1704067200 + 60 * 86400)), F.col("doc_id")
    return documents(spark, d).select(
        "doc_id", T.time_ago(F.col("modified_at"), now).alias("age"), T.whole_days_since(F.col("modified_at"), now).alias("days"),
        T.readable_bytes(id_ * id_ * 1031).alias("size"), T.readable_ms(id_).alias("took"), T.readable_eta(id_ * 7.5).alias("left_over"),
    )


@query(f"WITH {DOCS} SELECT doc_id, '#' || substr(hash, 1, 6) || ' ' || CAST(doc_id % 101 AS VARCHAR) || '% ' || collection || '/' || path || ' - ' || title AS row FROM docs")
def summary_rows(spark, d):
    """Results as lines for people."""
    docs = documents(spark, d).withColumns({"docid": P.docid(F.col("hash")), "score": F.col("doc_id") % 101 / 100, "file": F.concat_ws("/", "collection", "path")})
    return docs.select("doc_id", formatters.summary_row().alias("row"))


# texts


@query(f"WITH {DOCS} SELECT doc_id, sha256(regexp_replace(body, '(the|license)', '**\\1**', 'gi')) AS digest FROM docs")
def highlight_terms(spark, d):
    """Terms of three characters or more marked."""
    return documents(spark, d).select("doc_id", F.sha2(T.highlighted(F.col("body"), ["the", "of", "license"]), 256).alias("digest"))


@query(rf"""WITH {ROWS}, x AS (SELECT *, '全文 search' || n || 'カナ한글' || lang AS x FROM r)
SELECT doc_id, regexp_replace(x, '([\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Hangul}}])', ' \1 ', 'g') AS spaced, ['全', '文', 'search' || n, 'カ', 'ナ', '한', '글', lang] AS tokens, true AS is_cjk FROM x""")
def cjk_tokens(spark, d):
    """Han, kana and hangul characters stand alone, in the spaced text and as tokens."""
    x = F.concat(F.lit("全文 search"), F.col("n"), F.lit("カナ한글"), F.col("lang"))
    return rows(spark, d).select("doc_id", T.spaced_cjk(x).alias("spaced"), T.tokens(x).alias("tokens"), T.contains_cjk(x).alias("is_cjk"))


@query(f"""WITH {DOCS}, l AS (SELECT doc_id, unnest(string_split(body, '. ')) AS x, generate_subscripts(string_split(body, '. '), 1) - 1 AS i FROM docs),
s AS (SELECT doc_id, i, 2 * contains(lower(x), 'the')::INT + contains(lower(x), 'license')::INT + 0.5 * contains(lower(x), 'and')::INT AS s FROM l)
SELECT doc_id, CAST(i AS INTEGER) AS best FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i) = 1""")
def best_chunks(spark, d):
    """The chunk that holds most of a query's words (one given twice) and of its intent's."""
    parts = F.transform(F.split("body", r"\. ", -1), lambda x: F.struct(x.alias("text")))
    return documents(spark, d).select("doc_id", fusion.best_chunk(parts, ["the", "license", "the"], ["and"]).cast("int").alias("best"))


def _cut(first: int, count: int):
    return F.array_join(F.slice(F.split("text", " "), first, count), " ")


def _cut_sql(first: int, count: int) -> str:
    return f"array_to_string(string_split(text, ' ')[{first}:{first + count - 1}], ' ')"


@query(f"""WITH w AS (SELECT item_id, {_cut_sql(1, 3)} AS a, {_cut_sql(4, 3)} AS b, {_cut_sql(7, 3)} AS c FROM benchmark)
SELECT item_id, 'hyde: ' || c || chr(10) || 'lex: ' || b || chr(10) || 'vec: ' || a AS hyde_first, 'vec: ' || a || chr(10) || 'lex: ' || b || chr(10) || 'hyde: ' || c AS as_given FROM w""")
def expansion_lines(spark, d):
    """An expansion's parts as lines, blank and unknown ones dropped."""
    part = lambda t, x: F.struct(F.lit(t).alias("type"), x.alias("text"))
    every = F.array(part("vec", _cut(1, 3)), part("hyde", F.lit(" ")), part("lex", F.concat(_cut(4, 3), F.lit("  "))), part("other", _cut(1, 1)), part("hyde", _cut(7, 3)))
    return table(spark, d, "benchmark").select("item_id", expansion.output_text(every).alias("hyde_first"), expansion.output_text(every, hyde_first=False).alias("as_given"))


@query(f"""WITH w AS (SELECT item_id, lower({_cut_sql(1, 6)}) AS a, lower({_cut_sql(2, 6)}) AS b FROM benchmark),
s AS (SELECT *, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM w)
SELECT item_id, NOT contains(a, b) AND NOT contains(b, a) AND len(list_filter(x, lambda v: NOT list_contains(y, v))) + len(list_filter(y, lambda v: NOT list_contains(x, v))) >= 2 AS two_apart, false AS part_apart FROM s""")
def word_sets_differ(spark, d):
    """Whether two texts differ by so many words, neither holding the other."""
    return table(spark, d, "benchmark").select("item_id", expansion.differs(_cut(1, 6), _cut(2, 6), F.lit(2)).alias("two_apart"), expansion.differs(_cut(1, 6), _cut(2, 3), F.lit(0)).alias("part_apart"))


@query(f"WITH {DOCS} SELECT count(*) AS n_rows, count(DISTINCT hash) AS n_hashes, CAST(0 AS BIGINT) AS over_count, CAST(0 AS BIGINT) AS over_bytes FROM docs")
def embedding_batches(spark, d):
    """Batches of pending bodies: every row in one, none with too many or (but for a lone one) too large."""
    bodies = documents(spark, d).select("hash", "path", F.octet_length("body").cast("long").alias("n_bytes"))
    each = maintenance.batches(bodies, 8, 20_000).groupBy("partition", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b"), F.collect_set("hash").alias("h"))
    return each.agg(F.sum("n").alias("n_rows"), F.size(F.array_distinct(F.flatten(F.collect_list("h")))).cast("long").alias("n_hashes"), F.count_if(F.col("n") > 8).alias("over_count"), F.count_if((F.col("n") > 1) & (F.col("b") > 20_000)).alias("over_bytes"))


@query(f"""WITH RECURSIVE {DOCS}, o AS (SELECT doc_id, octet_length(encode(body)) AS b, row_number() OVER (ORDER BY hash, doc_id) AS r FROM docs),
fill AS (
  SELECT r, doc_id, CAST(0 AS BIGINT) AS batch, 1 AS n, b AS size FROM o WHERE r = 1
  UNION ALL
  SELECT o.r, o.doc_id, CASE WHEN n >= 8 OR size + o.b > 20000 THEN batch + 1 ELSE batch END, CASE WHEN n >= 8 OR size + o.b > 20000 THEN 1 ELSE n + 1 END,
    CASE WHEN n >= 8 OR size + o.b > 20000 THEN o.b ELSE size + o.b END
  FROM fill JOIN o ON o.r = fill.r + 1)
SELECT doc_id, batch FROM fill""")
def embedding_batches_in_order(spark, d):
    """Batches of at most 8 bodies and 20,000 bytes, filled greedily in the order of hashes over the whole table."""
    bodies = documents(spark, d).select("doc_id", "hash", F.octet_length("body").cast("long").alias("n_bytes"))
    kept = Warehouse(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/tarn-batches")
    return batching.greedy_batches(bodies, ["hash", "doc_id"], 8, 20_000, kept.staged).select("doc_id", "batch")


@query(rf"""WITH {DOCS}, t AS (SELECT doc_id, list_transform(string_split_regex(lower(body), '\s+'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) AS t FROM docs),
k AS (SELECT doc_id, list_filter(t, lambda x: length(x) > 1 AND NOT list_contains([{", ".join(f"'{w}'" for w in T.INTENT_STOP_WORDS)}], x)) AS t FROM t)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n, sha256(array_to_string(t, ' ')) AS digest FROM k""")
def intent_words(spark, d):
    """The words of texts that say something of an intent, in order."""
    words = T.intent_words(F.col("body"))
    return documents(spark, d).select("doc_id", F.size(words).alias("n"), F.sha2(F.array_join(words, " "), 256).alias("digest"))


@query(rf"""WITH {DOCS}, t AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]+')), lambda x: length(x) > 1 AND NOT list_contains([{", ".join(f"'{w}'" for w in evaluation.STOP_WORDS)}], x)) AS t FROM docs)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n, sha256(array_to_string(list_sort(t), ' ')) AS digest FROM t""")
def word_sets(spark, d):
    """Distinct words of texts without stop words."""
    words = evaluation.word_set(F.col("body"))
    return documents(spark, d).select("doc_id", F.size(words).alias("n"), F.sha2(F.array_join(F.array_sort(words), " "), 256).alias("digest"))


ADDRESSES = (("tarn://", "$lang", "/sub/", "$n", ".md"), ("//", "$lang", "/", "$n", ".md?index=other"), ("tarn:", "$lang", "/", "$n", ".md"), ("$lang", "/", "$n", ".md"), ("tarn:///", "$lang", "/a b-", "$n", ".md"), ("tarn://", "$lang"))


@query(f"""WITH {ROWS} SELECT doc_id, CASE WHEN doc_id % 6 <> 3 THEN lang END AS collection,
  CASE doc_id % 6 WHEN 0 THEN 'sub/' || n || '.md' WHEN 4 THEN 'a b-' || n || '.md' WHEN 5 THEN '' WHEN 3 THEN NULL ELSE n || '.md' END AS path FROM r""")
def virtual_parts(spark, d):
    """Collection and path of virtual paths in their spellings."""
    parts = P.virtual_parts(_one_of(*ADDRESSES))
    return rows(spark, d).select("doc_id", parts["collection"].alias("collection"), parts["path"].alias("path"))


RANGES = (("$n", ".md"), ("$n", ".md:3"), ("$n", ".md:2:2"), ("a:b/", "$n", ".md:0:0"), ("$n", ":900:1"))


@query(f"""WITH {DOCS}, l AS (SELECT doc_id, string_split(replace(body, '. ', chr(10)), chr(10)) AS l, CASE doc_id % 5 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 900 END AS a, CASE doc_id % 5 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 END AS c FROM docs)
SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 'a:b/' ELSE '' END || doc_id || CASE doc_id % 5 WHEN 4 THEN '' ELSE '.md' END AS name, a AS first, c AS count,
  sha256(coalesce(array_to_string(l[coalesce(a, 1) : coalesce(a, 1) + coalesce(c, len(l)) - 1], chr(10)), '')) AS digest FROM l""")
def line_ranges(spark, d):
    """Names with a range of lines after them, and these lines of the documents (a sentence ends a line too)."""
    docs = documents(spark, d).withColumns({"n": F.col("doc_id").cast("string"), "lines": F.regexp_replace("body", r"\. ", "\n")})
    range_ = lookup.line_range_of(_one_of(*RANGES))
    return docs.select("doc_id", range_["name"].alias("name"), range_["first"].alias("first"), range_["count"].alias("count"), F.sha2(T.line_range(F.col("lines"), range_["first"], range_["count"]), 256).alias("digest"))


ASKED = (("$lang", " plans -", "$n"), ("say \"", "$n", "\""), ("say \"", "$n"), ("$lang", "-", "$n"), ("two\nlines ", "$n"), ("no -\"", "$n", " x\""), ("- ", "$n"))


@query(f"""WITH {ROWS}, q AS (SELECT doc_id, {_one_of_sql(*ASKED)} AS q FROM r)
SELECT doc_id, position(chr(10) IN q) = 0 AND (len(string_split(q, '"')) - 1) % 2 = 0 AS lex, doc_id % 7 NOT IN (0, 5) AS semantic FROM q""")
def valid_queries(spark, d):
    """Which queries their languages allow: single lines with paired quotes, and no exclusion by meaning."""
    q = _one_of(*ASKED)
    return rows(spark, d).select("doc_id", lexquery.valid_lex(q).alias("lex"), lexquery.valid_semantic(q).alias("semantic"))


@query("""SELECT count(*) AS n_rows, count(DISTINCT lower(trim(text))) AS n_texts, CAST(0 AS BIGINT) AS n_in_both, count(*) >= 200 AS large, true AS near_share FROM benchmark""")
def training_split(spark, d):
    """Examples parted by a hash of their text: equal texts go to one side, whose share is near what was asked."""
    rows_ = evaluation.train_eval_split(table(spark, d, "benchmark").select(F.lower(F.trim("text")).alias("query")), 0.2)
    each = rows_.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "eval").alias("held"))
    n, held = F.sum("n"), F.sum("held")
    return each.agg(n.alias("n_rows"), F.count("query").alias("n_texts"), F.count_if((F.col("held") > 0) & (F.col("held") < F.col("n"))).alias("n_in_both"), (n >= 200).alias("large"), ((n < 200) | F.abs(held / n - 0.2).between(0, 0.1)).alias("near_share"))


# source files

#: Pieces of source files by turns, ~ being the piece's number. A mark /*@kind name@*/ is before each construct; texts, comments, macros and values hold words that would be constructs elsewhere.
PIECES = {
    "ts": (
        "// class No {}\n/*@func f~@*/function f~(a: string): void {\n  return `function no() { ${a} }`;\n}\n",
        "const t~ = \"export class No {}\", r~ = /class No {/;\n/*@iface I~@*/interface I~ { type: string }\n",
        "/*@class C~@*/class C~ { x = 1;\n  /*@method m~@*/private static async m~(a = { b: 1 }): Promise<{ c: number }> {}\n}\n",
        "/* import no from 'no'; */ /*@import@*/import { a~ } from \"b\";\nlet y~ = import('x');\n",
        "/*@func g~@*/const g~ = async (x) => x;\ndeclare function no(): void;\n",
        "/*@export@*/export /*@type T~@*/type T~ = string;\nlet type = 1;\n",
        "/*@enum E~@*/enum E~ { A }\n/*@class D~@*/@Bound({ class: 1 })\nclass D~ {}\n",
    ),
    "js": (
        "x~.class(function () {});\n/*@export@*/export default [1, 2];\n",
        "call('class No {}');\n/*@class C~@*/class C~ extends B {}\n",
        "const o~ = { a: 1,\n  /*@method m~@*/m~() { if (a) { b(); } } };\n",
        "/*@func f~@*/async function f~() {\n  /*@func g~@*/function g~() {}\n}\n",
    ),
    "go": (
        "// func No() {}\n/*@func F~@*/func F~(a string) string {\n\treturn `\nfunc no() {}\n`\n}\n",
        "var v~ = func(a int) int { return a }\n/*@method M~@*/func (s *S) M~() bool { return true }\n",
        "/* type No struct {} */\n/*@type T~@*/type T~ struct {\n\ta int\n}\n",
        "/*@import@*/import \"a/b~\"\n",
    ),
    "rs": (
        "/* /* fn no() {} */ struct No; */\n#[test]\n/*@func f~@*/pub async fn f~<'a>(x: &'a str) -> impl Fn() { r#\"fn no() {} \" \"# }\n",
        "make!{ struct No; fn no() {} }\n/*@struct S~@*/pub(crate) struct S~ { c: char }\n",
        "/*@trait T~@*/trait T~ { fn no(&self); type No; }\n/*@impl S~@*/impl T~ for S~ {}\n",
        "/*@enum E~@*/enum E~ { A = '{' as isize, B }\n/*@import@*/use a::b~;\n",
        "const Q~: char = '\"';\n/*@mod m~@*/mod m~;\n",
    ),
}


def _files_sql() -> str:
    piece = lambda x: "'" + x.replace("'", "''") + "'"
    turns = " ".join(f"WHEN {k} THEN ([{', '.join(map(piece, x))}])[i % {len(x)} + 1]" for k, x in enumerate(PIECES.values()))
    return f"""files AS (
  SELECT doc_id, array_to_string(list_transform(range(len(s)), lambda i: '// ' || s[i + 1] || chr(10) || replace(CASE doc_id % {len(PIECES)} {turns} END, '~', CAST(i AS VARCHAR))), '') AS body
  FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[\\n\\r]', ' ', 'g'), '. ') AS s FROM documents))"""


@query(rf"""WITH {_files_sql()},
m AS (SELECT doc_id, string_split_regex(body, '/\*@[^@]*@\*/') AS s, regexp_extract_all(body, '/\*@[^@]*@\*/') AS k FROM files),
u AS (SELECT doc_id, unnest(s[1 : len(k)]) AS s, unnest(k) AS k, generate_subscripts(k, 1) AS i FROM m),
p AS (SELECT *, sum(length(s) + length(k)) OVER w AS pos, sum(length(s) - length(replace(s, chr(10), ''))) OVER w AS n FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(n + 1 AS INTEGER) AS line, regexp_extract(k, '@([a-z]+)', 1) AS kind, nullif(regexp_extract(k, ' ([^@]+)@', 1), '') AS name,
  CASE regexp_extract(k, '@([a-z]+)', 1) WHEN 'import' THEN 60 WHEN 'type' THEN 80 WHEN 'enum' THEN 80 WHEN 'func' THEN 90 WHEN 'method' THEN 90 WHEN 'export' THEN 90 ELSE 100 END AS score FROM p""")
def code_symbols(spark, d):
    """Constructs of source files in four languages, made of a document's sentences (as comments) and marked pieces by turns."""
    text = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n\r]", " "), r"\. ", -1)
    turns = [F.array(*map(F.lit, x)) for x in PIECES.values()]
    turn = lambda i: reduce(lambda out, k: F.when(F.col("doc_id") % len(PIECES) == k, F.get(turns[k], i % F.size(turns[k]))).otherwise(out), range(len(PIECES)), F.lit(""))
    body = F.array_join(F.transform(text, lambda s, i: F.concat(F.lit("// "), s, F.lit("\n"), F.replace(turn(i), F.lit("~"), i.cast("string")))), "")
    files = table(spark, d, "documents").select("doc_id", _one_of(*((f"x.{e}",) for e in PIECES)).alias("path"), body.alias("body"))
    return code.symbols(files).drop("path")
