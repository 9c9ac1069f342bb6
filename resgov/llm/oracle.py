"""DuckDB SQL for the operators whose results SQL can state, over the same whole tables."""

from __future__ import annotations

LINE_END = "chr(10)"

BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
d AS (SELECT *, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr({BASE32}, 1 + CAST(
    16 * (substr(bits, 5 * i + 1, 1) = '1')::INT + 8 * (substr(bits, 5 * i + 2, 1) = '1')::INT + 4 * (substr(bits, 5 * i + 3, 1) = '1')::INT
    + 2 * (substr(bits, 5 * i + 4, 1) = '1')::INT + (substr(bits, 5 * i + 5, 1) = '1')::INT AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last > page_id THEN last END AS refers_to
FROM d"""

COMPONENTS = """
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a),
lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a)"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
          WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{COMPONENTS},
degree AS (SELECT a, count(*) AS n FROM sides GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN degree d ON d.a = vec_id LEFT JOIN lowest l ON l.a = vec_id"""

NEAR_DOCUMENTS = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM s),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM one x JOIN one y ON x.k = y.k AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
          GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
{COMPONENTS}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
FROM s LEFT JOIN lowest ON a = doc_id"""

FILL_IN_MIDDLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h, string_split(coalesce(text, ''), {LINE_END}) AS lines FROM documents),
n AS (SELECT *, len(lines) - 1 AS ends, len(lines) - 1 + (lines[-1] <> '')::INT AS n FROM d),
c AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM n),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 100 THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
        least(c1, c2) AS low, greatest(c1, c2) AS high FROM c),
k AS (SELECT *, CASE WHEN low = 0 THEN '' WHEN low > ends THEN t ELSE array_to_string(lines[1:low], {LINE_END}) || {LINE_END} END AS prefix,
        CASE WHEN high = 0 THEN '' WHEN high > ends THEN t ELSE array_to_string(lines[1:high], {LINE_END}) || {LINE_END} END AS most FROM f),
o AS (SELECT *, substr(most, length(prefix) + 1) AS middle, substr(t, length(most) + 1) AS suffix FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.id % 100 = 0 AND len(a.q) = len(b.q) AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": WARC, "op5_embedding_dedup": NEAR_VECTORS, "op10_near_dedup": NEAR_DOCUMENTS, "op11_fill_in_middle": FILL_IN_MIDDLE, "op12_hard_negatives": HARD_NEGATIVES}
