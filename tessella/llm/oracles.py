"""SQL for DuckDB that answers the same questions by brute force."""

OP2_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), starts AS (
  SELECT r, s, md5(substr(h, 2 * s + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, n - 399)) AS s FROM d WHERE n >= 400)
), hits AS (
  SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS c FROM starts) WHERE c > 1
), marked AS (
  SELECT r, s, CASE WHEN s > lag(s) OVER (PARTITION BY r ORDER BY s) + 400 THEN 1 ELSE 0 END AS fresh FROM hits
), spans AS (
  SELECT r, min(s) AS a, max(s) + 400 AS b FROM (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS g FROM marked) GROUP BY r, g
), gaps AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL
  SELECT r, max(b), NULL FROM spans GROUP BY r
), kept AS (
  SELECT g.r, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS h FROM gaps g JOIN d ON g.r = d.r GROUP BY g.r
), sums AS (
  SELECT r, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS runs FROM spans GROUP BY r
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept k ON d.r = k.r LEFT JOIN sums s ON d.r = s.r
"""

#: Components of links (a, b) over the ids of the first query's rows.
_REACH = """
reach AS (
  SELECT a AS id, b AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
), component AS (
  SELECT id, min(other) AS least FROM reach GROUP BY id
)
"""

OP6_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id, d.doc_id <= coalesce(least, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN component c ON d.doc_id = c.id
"""

OP9_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.9
), {_REACH}, n AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, least(m.vec_id, coalesce(least, m.vec_id)) AS component_id, m.vec_id <= coalesce(least, m.vec_id) AS kept
FROM embeddings m LEFT JOIN n ON m.vec_id = n.a LEFT JOIN component c ON m.vec_id = c.id
"""
