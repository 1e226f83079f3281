"""SQL that the registered queries must agree with."""

NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Unsigned crc32 of the decimal c, by bits.
CRC = """xor(list_reduce(list_transform(string_split(cast(c AS VARCHAR), ''), lambda ch: cast(ascii(ch) AS BIGINT)), lambda a, x:
  list_reduce(range(8), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(a, x)), 4294967295), 4294967295)"""

ORACLES = {
    "op1_exact_dedup": f"""
WITH n AS (SELECT doc_id, {NORM} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, cast(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f""",
    "op11_conversation_trie": f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS r, coalesce(text, '') AS x
  FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, c - c % 20 AS base, {CRC} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
q AS (SELECT i.c, 0 AS own, p, r, x FROM i JOIN t ON t.c = i.base AND t.p <= i.h UNION ALL SELECT i.c, 1, p, r, x FROM i JOIN t ON t.c = i.c AND t.p > i.h),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS depth, sha256(concat(length(r), ':', r, x)) AS k,
  len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words FROM q),
pre AS (SELECT c, depth, string_agg(k, '') OVER (PARTITION BY c ORDER BY depth) AS k, words FROM d UNION ALL SELECT c, 0, '', 0 FROM i),
n AS (SELECT k, depth, min(c) AS conv_id, count(*) AS n_convs, min(words) AS words FROM pre GROUP BY k, depth),
ended AS (SELECT k, string_agg(cast(c AS VARCHAR), ',' ORDER BY c) AS ids, count(*) AS n_ends FROM (SELECT c, arg_max(k, depth) AS k FROM pre GROUP BY c) GROUP BY k),
kids AS (SELECT left(k, length(k) - 64) AS k, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
tree AS (SELECT a.k, sum((b.n_convs - 1) * b.words) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM n a JOIN n b ON starts_with(b.k, a.k) LEFT JOIN kids ON kids.k = b.k GROUP BY a.k)
SELECT n.conv_id, cast(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, cast(coalesce(kids.n, 0) AS BIGINT) AS n_children,
  cast(leaves AS BIGINT) AS n_leaves, cast(saved AS BIGINT) AS saved_tokens, cast(coalesce(n_ends, 0) AS BIGINT) AS n_ends, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN tree ON tree.k = n.k LEFT JOIN kids ON kids.k = n.k LEFT JOIN ended ON ended.k = n.k
LEFT JOIN n up ON n.depth > 0 AND up.k = left(n.k, length(n.k) - 64)""",
}
