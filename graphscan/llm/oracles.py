"""DuckDB SQL for the operators that SQL can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

op5_decontaminate_sql = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
n AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM n, unnest(generate_series(1, len(w) - k + 1)) AS t(i)),
ks AS (SELECT DISTINCT k FROM n),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM d, ks, unnest(generate_series(1, len(w) - k + 1)) AS t(i) WHERE len(w) >= k),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, g)),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(generate_series(i, i + k - 1)) AS t(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""

op6_top_k_sql = """
WITH c AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1] * z[2], 0)))::BIGINT AS score FROM c AS q, c WHERE q.vec_id % 50 = 0 AND q.r <> c.r),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 5
"""

_SHINGLES = r"""
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(""" + _LOWER.format("text") + r""", '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS g FROM d)"""

op7_jaccard_join_sql = f"""
WITH RECURSIVE {_SHINGLES},
u AS (SELECT r, doc_id, len(g) AS n, unnest(g) AS x FROM s),
o AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM u AS a JOIN u AS b ON a.x = b.x AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * c >= 60 * (n + m - c)),
t AS (SELECT r, r AS z FROM s UNION SELECT t.r, l.b FROM t JOIN l ON l.a = t.z),
m AS (SELECT t.r, min(s.doc_id) AS component_id FROM t JOIN s ON s.r = t.z GROUP BY 1)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, coalesce(k.n, 0)::BIGINT AS n_similar, m.component_id
FROM s JOIN m USING (r) LEFT JOIN (SELECT a AS r, count(*) AS n FROM l GROUP BY 1) AS k USING (r)
"""
