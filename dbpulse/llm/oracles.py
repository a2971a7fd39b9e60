"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP2_SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM tokens
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS item FROM shingled
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM items x JOIN items y ON x.item = y.item AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION
  SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.other = l.a
), component AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM shingled s JOIN component c ON c.node = s.doc_id
"""

#: Base32 of a SHA-1: four characters of five bits from each five hexadecimal digits.
OP6_SQL = r"""
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
), digits AS (
  SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(hex, CAST(g * 5 + 1 AS BIGINT), 5) AS INTEGER)) AS groups FROM payloads
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(groups, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, true AS complete
FROM digits
"""

OP8_SQL = r"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), unit AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM vectors
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM unit x JOIN unit y ON x.vec_id <> y.vec_id AND list_dot_product(x.v, y.v) >= 0.95 * x.norm * y.norm
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), component AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, k.component_id, e.vec_id = k.component_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id JOIN component k ON k.node = e.vec_id
"""

#: The checksum of a decimal number, bit by bit: each byte is folded in by eight steps of the reflected polynomial 0xEDB88320.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(CAST(c AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(c AS VARCHAR), k, 1)) AS BIGINT))),
    lambda x, y: list_reduce(list_prepend(xor(x, y), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"""

OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, strlen(coalesce(text, '')) AS size,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS unit
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT c, h, least(h, coalesce((SELECT max(i) FROM turns t WHERE t.c = k.base), 0)) AS taken
  FROM (SELECT c, c - c % 5 AS base, {_CRC32} % 9 AS h FROM (SELECT DISTINCT c FROM turns)) k
), rebuilt AS (
  SELECT v.c, t.i AS d, t.unit, t.size FROM conv v JOIN turns t ON t.c = v.c - v.c % 5 AND t.i <= v.h
  UNION ALL
  SELECT v.c, v.taken + t.i - v.h, t.unit, t.size FROM conv v JOIN turns t ON t.c = v.c AND t.i > v.h
), prefixes AS (
  SELECT c, d, size, string_agg(unit, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS p FROM rebuilt
  UNION ALL
  SELECT c, 0, 0, '' FROM conv
), marked AS (
  SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM prefixes
), nodes AS (
  SELECT p, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(size) AS size, count(*) FILTER (WHERE NOT ends) = 0 AS leaf,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM marked GROUP BY p
), below AS (
  SELECT substr(p, 1, CAST(k * 64 AS BIGINT)) AS p, count(*) FILTER (WHERE leaf) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM nodes) GROUP BY 1
), children AS (
  SELECT substr(p, 1, CAST((depth - 1) * 64 AS BIGINT)) AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.p = n.p LEFT JOIN children k ON k.p = n.p LEFT JOIN nodes u ON n.depth > 0 AND u.p = substr(n.p, 1, CAST((n.depth - 1) * 64 AS BIGINT))
"""
