"""DuckDB SQL for the operators that SQL can express."""

WHITE = r"[\x20\x09-\x0D]"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SPACED}') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
l AS (SELECT doc_id, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS x FROM t),
s AS (
  SELECT DISTINCT doc_id, array_to_string(x, ' ') AS x FROM l WHERE len(x) = 5
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark),
dt AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
it AS (SELECT item_id, least(10, len(w)) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM i),
iw AS (SELECT item_id, n, list(word) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM it),
windows AS (SELECT DISTINCT item_id, n, array_to_string(l[1:n], ' ') AS x FROM iw WHERE len(l) >= n),
sizes AS (SELECT DISTINCT n FROM windows),
dw AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM dt),
at_ AS (SELECT doc_id, pos, n, array_to_string(l[1:n], ' ') AS x FROM dw, sizes WHERE len(l) >= n),
occ AS (SELECT doc_id, pos, at_.n AS n, item_id FROM at_ JOIN windows USING (n, x)),
hit AS (SELECT doc_id, count(DISTINCT pos + k) AS n_hit FROM occ, range(10) r(k) WHERE k < n GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM occ GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
l AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS x FROM t),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY array_to_string(x, ' ') ORDER BY doc_id, pos) AS r FROM l WHERE len(x) = 20),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, range(20) o(k) WHERE r > 1),
kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.pos) AS x, count(*) AS n FROM t ANTI JOIN gone g ON g.doc_id = t.doc_id AND g.pos = t.pos GROUP BY t.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP9 = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '{WHITE}', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0"

OP12 = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND {FINITE}),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.r <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def _codes_sql() -> str:
    """Rounds of assignment and floor means over (vector, part, component) rows."""
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS pos
  FROM embeddings WHERE {FINITE}),
flat AS (SELECT vec_id, pos, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS d, len(v) // 8 AS w FROM kept),
x AS MATERIALIZED (SELECT vec_id, pos, d // w AS part, d % w AS d, x FROM flat),
c0 AS MATERIALIZED (SELECT part, pos AS entry, d, x FROM x WHERE pos < 16)"""
    for k in range(7):
        sql += f""",
f{k} AS (SELECT x.vec_id, x.part, c.entry, sum((x.x - c.x) * (x.x - c.x)) AS far FROM x JOIN c{k} c ON c.part = x.part AND c.d = x.d GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT vec_id, part, min_by(entry, (far, entry)) AS entry, min(far) AS far FROM f{k} GROUP BY ALL)"""
        if k < 6:
            sql += f""",
m{k} AS (
  SELECT a.part, a.entry, x.d, CASE WHEN sum(x.x) >= 0 OR sum(x.x) % count(*) = 0 THEN sum(x.x) // count(*) ELSE sum(x.x) // count(*) - 1 END AS x
  FROM x JOIN a{k} a ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.d, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry AND m.d = c.d)"""
    return sql + """,
book AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, d)) AS h FROM c6),
code AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a6 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM code JOIN kept USING (vec_id), book
"""


OP13 = _codes_sql()

SQL = {"op3_ngram_jaccard": OP3, "op5_decontamination": OP5, "op8_substring_dedup": OP8, "op9_exact_dedup": OP9, "op12_hard_negatives": OP12, "op13_vector_codes": OP13}
