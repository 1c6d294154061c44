"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import mixing


def _values(d: dict[str, float]) -> str:
    return ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in d.items())


#: Steps of the recursive raking, far beyond what the tolerance needs, and rounds of refilling.
RAKING_STEPS, REFILLS = 480, 24


def mixing_sql() -> str:
    """Raking and refilling as recursive queries over the table of cells."""
    case = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in mixing.TOPICS.items())
    known = lambda d: "CASE WHEN {0} IN ({1}) THEN {0} ELSE '_rest' END".format(d, ", ".join(f"'{k}'" for k in mixing.TARGETS[d] if k != mixing.REST))
    dims = mixing.DIMENSIONS
    aims = [f"a_{x} AS MATERIALIZED (SELECT k, aim / sum(aim) OVER () AS aim FROM (VALUES {_values(mixing.TARGETS[x])}) v(k, aim) WHERE k IN (SELECT g_{x} FROM w0))" for x in dims]
    pick = lambda f: "CASE step % 3 " + " ".join(f"WHEN {i} THEN {f(x)}" for i, x in enumerate(dims)) + " END"
    return f"""WITH RECURSIVE
d AS (SELECT doc_id, source, lang, {known('source')} AS g_source, {known('lang')} AS g_lang, CASE {case} ELSE 'prose' END AS g_topic, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
w0 AS MATERIALIZED (SELECT g_source, g_lang, g_topic, sum(n_tokens)::BIGINT AS n, sum(n_tokens)::DOUBLE AS w FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
{", ".join(aims)},
c AS MATERIALIZED (SELECT w0.*, a_source.aim AS aim_source, a_lang.aim AS aim_lang, a_topic.aim AS aim_topic FROM w0 JOIN a_source ON a_source.k = g_source JOIN a_lang ON a_lang.k = g_lang JOIN a_topic ON a_topic.k = g_topic),
r AS (SELECT 0 AS step, g_source, g_lang, g_topic, n, w, aim_source, aim_lang, aim_topic FROM c
  UNION ALL SELECT step + 1, g_source, g_lang, g_topic, n, w * ({pick(lambda x: f'aim_{x}')}) / sum(w) OVER (PARTITION BY {pick(lambda x: f'g_{x}')}), aim_source, aim_lang, aim_topic FROM r WHERE step < {RAKING_STEPS}),
f AS MATERIALIZED (SELECT g_source, g_lang, g_topic, n, w FROM r WHERE step = {RAKING_STEPS}),
s AS (SELECT 0 AS round, {mixing.BUDGET} * sum(n) AS aim, {mixing.BUDGET} * sum(n) / sum(w) AS scale FROM f
  UNION ALL SELECT round + 1, aim, coalesce((SELECT greatest(0, s.aim - coalesce(sum(n) FILTER (s.scale * w / n >= 1), 0)) / nullif(sum(w) FILTER (s.scale * w / n < 1), 0) FROM f), scale) FROM s WHERE round < {REFILLS}),
p AS (SELECT g_source, g_lang, g_topic, least(1.0, (SELECT scale FROM s WHERE round = {REFILLS}) * w / n) AS p FROM f)
SELECT doc_id, source, lang, g_topic AS topic, n_tokens, round(coalesce(p, 0), 6) AS probability,
       ('0x' || substring(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < coalesce(p, 0) AS sampled
FROM d LEFT JOIN p USING (g_source, g_lang, g_topic)"""


OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS lo FROM w GROUP BY s),
c AS (SELECT w.doc_id, w.i FROM w JOIN m USING (s) WHERE m.lo < w.doc_id),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS first FROM c),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
p AS (SELECT r.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0))) AS piece FROM r JOIN d USING (doc_id)),
k AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(piece, '' ORDER BY a) AS kept FROM p GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP5 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bwin AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bwin),
dwin AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT d.doc_id, d.i, d.k, b.item_id FROM dwin d JOIN bwin b ON d.k = b.k AND d.s = b.s),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

OP9 = r"""
WITH r AS (
  SELECT CAST(floor(page_id / 256) AS BIGINT) AS file, page_id % 256 AS idx, page_id,
         concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10),
                'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', CAST(strlen(coalesce(html, '')) AS VARCHAR), chr(13), chr(10), chr(13), chr(10),
                coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS a,
         substring(md5(CAST(page_id AS VARCHAR)), 1, 2) AS draw
  FROM pages),
l0 AS (
  SELECT file, idx, page_id, strlen(a) AS n_bytes, sha256(a) AS a,
         sha256(CASE draw WHEN '0a' THEN concat('X', substring(a, 2)) WHEN '0b' THEN substring(a, 1, 40) ELSE a END) AS b
  FROM r),
l1 AS (SELECT file, idx // 16 AS idx, sha256(string_agg(a, ',' ORDER BY idx)) AS a, sha256(string_agg(b, ',' ORDER BY idx)) AS b FROM l0 GROUP BY file, l0.idx // 16),
l2 AS (SELECT file, sha256(string_agg(a, ',' ORDER BY idx)) AS a, sha256(string_agg(b, ',' ORDER BY idx)) AS b FROM l1 GROUP BY file),
bad AS (SELECT file, count(*) AS n, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY idx) AS ids FROM l0 WHERE a <> b GROUP BY file),
c1 AS (SELECT l1.file, count(*) AS n FROM l1 JOIN l2 USING (file) WHERE l2.a <> l2.b GROUP BY l1.file),
c0 AS (SELECT l0.file, count(*) AS n FROM l0 JOIN l1 ON l0.file = l1.file AND l0.idx // 16 = l1.idx WHERE l1.a <> l1.b GROUP BY l0.file),
n AS (SELECT file, count(*) AS n_records, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM l0 GROUP BY file)
SELECT n.file, n_records, n_bytes, l2.a AS root_a, l2.b AS root_b, 1 + coalesce(c1.n, 0) + coalesce(c0.n, 0) AS n_nodes_compared,
       coalesce(bad.n, 0) AS n_corrupt, coalesce(bad.ids, '') AS corrupt_ids
FROM n JOIN l2 USING (file) LEFT JOIN bad USING (file) LEFT JOIN c1 USING (file) LEFT JOIN c0 USING (file)
"""



def _crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, over the table `crc` of (t): the 256 remainders as a list."""
    bytes_of = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_of}), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295::BIGINT)"


CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS t)"

OP11 = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
s AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s, w, count(*) AS n FROM r GROUP BY ALL),
h AS MATERIALIZED (SELECT w, n, {_crc32('s')} AS h FROM s, crc),
d AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
c AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b FROM c a JOIN c b ON a.cut = b.cut AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT c.word, v.word FROM c JOIN v ON c.cut = v.word
  UNION SELECT v.word, c.word FROM c JOIN v ON c.cut = v.word),
b AS (SELECT a, count(*) AS n_near, first(b ORDER BY v.n DESC, b) AS best, max(v.n) AS best_n FROM p JOIN v ON v.word = b GROUP BY a),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM v LEFT JOIN b ON a = word),
w AS (SELECT word, word AS here, 0 AS k FROM f UNION ALL SELECT w.word, f.form, k + 1 FROM w JOIN f ON f.word = w.here WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(here, k) AS root FROM w GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
"""

OP12 = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE * 1024) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda c: floor(c)) AS e FROM x WHERE len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP13 = f"""
WITH {CRC_TABLE},
t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS idx FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
u AS (
  SELECT c.conv_id, 0 AS own, idx, role, text FROM c JOIN t ON t.conv_id = c.base WHERE idx <= h
  UNION ALL SELECT c.conv_id, 1, idx, role, text FROM c JOIN t USING (conv_id) WHERE idx > h),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, idx) AS depth, sha256(octet_length(encode(role))::VARCHAR || ':' || role || text) AS k, octet_length(encode(text)) AS size FROM u),
g AS MATERIALIZED (SELECT conv_id, depth, size, list(k) OVER (PARTITION BY conv_id ORDER BY depth) AS path, count(*) OVER (PARTITION BY conv_id) AS len FROM n),
m AS MATERIALIZED (SELECT conv_id, depth, size, array_to_string(path, ',') AS path, array_to_string(path[:-2], ',') AS above, len FROM g UNION ALL SELECT conv_id, 0, 0, '', NULL, coalesce(x.len, 0) FROM c LEFT JOIN (SELECT conv_id, max(len) AS len FROM g GROUP BY conv_id) x USING (conv_id)),
o AS MATERIALIZED (
  SELECT depth, path, min(conv_id) AS conv_id, any_value(above) AS above, any_value(size) AS size, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = depth), '') AS ends
  FROM m GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n_children FROM o WHERE depth > 0 GROUP BY ALL),
z AS (SELECT o.*, coalesce(n_children, 0) AS n_children FROM o LEFT JOIN k USING (depth, path)),
y AS (
  SELECT a.depth, a.path, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved
  FROM z a JOIN z b ON a.depth = 0 OR (b.depth >= a.depth AND substr(b.path, 1, 65 * a.depth - 1) = a.path) GROUP BY ALL)
SELECT z.conv_id, CAST(z.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, z.n_convs, z.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(z.ends) AS ends_sha256
FROM z JOIN y USING (depth, path) LEFT JOIN o p ON p.depth = z.depth - 1 AND p.path = z.above
"""

ORACLES = {"op3_mixing": mixing_sql(), "op4_suffix_dedup": OP4, "op5_decontamination": OP5, "op9_warc_fixity": OP9, "op11_spelling": OP11, "op12_topk": OP12, "op13_prefix_trie": OP13}
