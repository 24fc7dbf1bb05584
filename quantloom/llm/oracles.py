"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

_OP1 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
d AS (
  SELECT page_id, payload_bytes, hex,
         list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = min(page_id) OVER w THEN NULL ELSE min(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY hex, payload_bytes)
"""

# Exact containment over all pairs that share a shingle: what the sketches propose and the verification confirms.
_SHINGLES = """
  SELECT {id}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT {id}, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM {table})
"""
_OP3 = f"""
WITH d AS (SELECT DISTINCT * FROM ({_SHINGLES.format(id="doc_id", table="documents")})),
q AS (SELECT DISTINCT * FROM ({_SHINGLES.format(id="item_id", table="benchmark")})),
n AS (SELECT item_id, count(*) AS item_shingles FROM q GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN q USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment
FROM c JOIN n USING (item_id) WHERE shared >= ceil(item_shingles * 0.8 - 1e-9)
"""

_OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS f FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.f, c.f) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

# Components by closing the links under reachability.
_OP7 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

_OP12 = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || x[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || x[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || x[25:32])::BIGINT % 100 < 50 AS spm FROM u),
c AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""

# h is the CRC-32 of the decimal id, bit by bit; a node is the digest of its turns' digests; subtrees are joined by what stands above each node.
_OP13 = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, d, strlen(x) AS bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS pos FROM t),
bits AS (
  SELECT c, flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: list_transform(range(0, 8), lambda i: (ascii(s) >> i::INT) & 1))) AS bits FROM (SELECT DISTINCT c FROM o)),
h AS (
  SELECT c, c - ((c % 5) + 5) % 5 AS donor,
         xor(list_reduce(list_transform(bits, lambda b: b::BIGINT), lambda k, b: CASE WHEN xor(k, b) & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END, 4294967295::BIGINT), 4294967295) % 9 AS h FROM bits),
b AS (
  SELECT h.c, 0 AS part, o.pos, o.d, o.bytes FROM h JOIN o ON o.c = h.donor AND o.pos <= h.h
  UNION ALL SELECT h.c, 1, o.pos, o.d, o.bytes FROM h JOIN o ON o.c = h.c AND o.pos > h.h),
n AS (SELECT c, d, bytes, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM b),
p AS (
  SELECT c, depth, bytes, sha256(string_agg(d, '') OVER (PARTITION BY c ORDER BY depth)) AS k FROM n
  UNION ALL SELECT c, 0, 0, '' FROM h),
e AS (SELECT c, max(depth) AS depth FROM p GROUP BY c),
node AS (SELECT k, any_value(depth) AS depth, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes FROM p GROUP BY k),
up AS (SELECT DISTINCT a.k, b.k AS parent FROM p a JOIN p b ON a.c = b.c AND b.depth = a.depth - 1),
kids AS (SELECT parent AS k, count(*) AS n FROM up GROUP BY parent),
sub AS (
  SELECT p.k, sum((u.n - 1) * u.bytes) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM node u LEFT JOIN kids ON kids.k = u.k JOIN p ON p.c = u.c AND p.depth <= u.depth GROUP BY p.k),
ends AS (SELECT p.k, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS ids FROM p JOIN e ON e.c = p.c AND e.depth = p.depth GROUP BY p.k)
SELECT node.c AS conv_id, node.depth, par.c AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children, sub.leaves AS n_leaves,
       sub.saved::BIGINT AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM node JOIN sub USING (k) LEFT JOIN kids USING (k) LEFT JOIN up USING (k) LEFT JOIN node par ON par.k = up.parent LEFT JOIN ends ON ends.k = node.k
"""

SQL = {"op1_warc": _OP1, "op3_decontamination": _OP3, "op6_topk": _OP6, "op7_minhash": _OP7, "op12_fill_in_middle": _OP12, "op13_prefix_trie": _OP13}
