"""DuckDB SQL of the operators that SQL can express. Fitted models, draws and packings have none; tests hold those
against brute force."""

from __future__ import annotations

#: crc32 of a decimal number ``s``, bit by bit.
CRC32 = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(
      list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, unused: xor(x >> 1, (x & 1) * 3988292384)
    )
  ), 4294967295)"""

CONVERSATION_TRIE = f"""
WITH turns AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS size,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS code
  FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, code) AS pos FROM turns
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS leader, {CRC32} % 6 AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM numbered)
), mixed AS (
  SELECT c.conv_id, n.pos, n.code, n.size FROM convs c JOIN numbered n ON n.conv_id = c.leader AND n.pos <= c.h
  UNION ALL
  SELECT c.conv_id, n.pos, n.code, n.size FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.pos > c.h
), rebuilt AS (
  SELECT conv_id, row_number() OVER w AS depth, size, string_agg(code, '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM mixed WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), prefixes AS (
  SELECT conv_id, depth, size, sha256(prefix) AS prefix, coalesce(sha256(lag(prefix) OVER (PARTITION BY conv_id ORDER BY depth)), 'root') AS before
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM convs
), nodes AS (
  SELECT depth, prefix, any_value(before) AS before, any_value(size) AS size, min(conv_id) AS first, count(*) AS n FROM prefixes GROUP BY ALL
), children AS (
  SELECT depth - 1 AS depth, before AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), below AS (
  SELECT a.depth, a.prefix, sum((n.n - 1) * n.size) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM nodes n JOIN prefixes a ON a.conv_id = n.first AND a.depth <= n.depth
  LEFT JOIN children c ON c.depth = n.depth AND c.prefix = n.prefix
  GROUP BY ALL
), ends AS (
  SELECT depth, prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT * FROM prefixes QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY ALL
)
SELECT n.first AS conv_id, n.depth::BIGINT AS depth, p.first AS parent_conv_id, n.n AS n_convs, coalesce(c.n, 0) AS n_children,
  b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.before
LEFT JOIN children c ON c.depth = n.depth AND c.prefix = n.prefix
LEFT JOIN ends e ON e.depth = n.depth AND e.prefix = n.prefix
JOIN below b ON b.depth = n.depth AND b.prefix = n.prefix
"""

WARC = """
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first
  FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages)
)
"""

#: Links of ``links (a, b)`` between ``nodes (id)``: the smallest id that each reaches.
COMPONENTS = """edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT id, id AS other FROM nodes
  UNION SELECT r.id, e.b FROM reached r JOIN edges e ON e.a = r.other
), components AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)"""

JACCARD = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM worded
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
), nodes AS (SELECT DISTINCT doc_id AS id FROM documents
), {COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN components c ON c.id = d.doc_id
"""

VECTORS = f"""
WITH RECURSIVE doubles AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), usable AS (
  SELECT * FROM doubles WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: abs(x))) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.95
), nodes AS (SELECT DISTINCT vec_id AS id FROM embeddings
), {COMPONENTS}, counts AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN components c ON c.id = vec_id LEFT JOIN counts k ON k.id = vec_id
"""

ORACLE = {
    "op1_vector_dedup": VECTORS,
    "op3_warc": WARC,
    "op7_jaccard_join": JACCARD,
    "op11_conversation_trie": CONVERSATION_TRIE,
    "op9_exact_dedup": """
        WITH h AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        )
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM h
    """,
}
