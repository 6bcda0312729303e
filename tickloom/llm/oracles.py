"""DuckDB SQL for the queries that SQL can express; each is written from the contract, not from the Spark code."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, list_slice(w, i, i + least(13, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)
),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(generate_series(1, len(w) - k + 1)) AS i, w FROM d, ks WHERE len(w) >= k),
hits AS (SELECT doc_id, i, h.k, item_id FROM (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS g FROM dw) h JOIN bw ON h.k = bw.k AND h.g = bw.g),
hitwords AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY 1),
hititems AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hitwords USING (doc_id) LEFT JOIN hititems USING (doc_id)
"""

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, cast(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""


OP5 = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT q.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS n
  FROM q LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(cast(doc_id AS VARCHAR), 'no id ' || md5(coalesce(text, ''))) || ':mix') AS h FROM documents
),
s AS (
  SELECT source, cast(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
),
b AS (SELECT cast(sum(source_size) AS BIGINT) AS b FROM s),
r AS (
  SELECT s.*, b.b - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM s, b
),
l AS (SELECT rest, ws FROM r WHERE 3 * source_size * ws > w * rest ORDER BY 3.0 * source_size / w, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN l.ws IS NULL OR 3 * source_size * l.ws <= w * l.rest THEN cast(3 * source_size AS DOUBLE)
    ELSE cast(w * l.rest AS DOUBLE) / cast(l.ws AS DOUBLE) END AS target FROM s LEFT JOIN l ON true
),
u AS (
  SELECT d.*, t.source_size, t.target, cast(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
c AS (SELECT doc_id, h, size, cast(e * source_size + upto AS DOUBLE) / target AS finish FROM u, range(3) x(e) WHERE size > 0 AND target > 0),
k AS (SELECT doc_id, h, size, sum(size) OVER (ORDER BY finish RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM c),
m AS (SELECT doc_id, cast(sum(size) AS BIGINT) AS taken FROM k, b WHERE total <= b GROUP BY doc_id)
SELECT u.doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM u LEFT JOIN m ON u.doc_id = m.doc_id
"""


# The turns that the query makes of the table (its rule is on conv_id and turn), and what has to come of them.
OP9 = r"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text, (conv_id * 3 + turn) % 7 AS k, (conv_id + turn) % 2 AS shape, 'c' || turn AS id, (conv_id + 2 * turn) % 5 <> 0 AS answered FROM conversations),
g AS (SELECT *, CASE WHEN k % 2 = 0 THEN turn + 1 ELSE turn - 1 END AS logged FROM t WHERE role = 'assistant' AND answered),
l AS (
  SELECT conv_id, turn, role, 'message' AS kind, NULL AS call_id, NULL AS linked, '' AS problem, turn AS o_turn, 0 AS o_part, 0 AS o_after,
    CASE WHEN role = 'assistant' THEN cast(json_object('content', coalesce(text, ''), 'kind', 'message', 'role', role, 'turn', turn) AS VARCHAR) ELSE cast(json_object('content', text, 'kind', 'message', 'role', role, 'turn', turn) AS VARCHAR) END AS json FROM t
  UNION ALL
  SELECT conv_id, turn, role, 'call', id, answered,
    CASE WHEN shape = 0 AND k = 0 THEN 'missing: query' WHEN shape = 1 AND k % 3 = 0 THEN 'wrong type: words' ELSE '' END, turn, 1, 0,
    CASE WHEN shape = 0 AND k = 0 THEN cast(json_object('arguments', json_object('words', k), 'call_id', id, 'kind', 'call', 'name', 'lookup', 'role', role, 'turn', turn) AS VARCHAR)
      WHEN shape = 0 THEN cast(json_object('arguments', json_object('query', substr(md5(coalesce(text, '')), 1, 8), 'words', k), 'call_id', id, 'kind', 'call', 'name', 'lookup', 'role', role, 'turn', turn) AS VARCHAR)
      WHEN k % 3 = 0 THEN cast(json_object('arguments', json_object('words', 'many'), 'call_id', id, 'extra', json_object('type', 'function'), 'kind', 'call', 'name', 'count', 'role', role, 'turn', turn) AS VARCHAR)
      ELSE cast(json_object('arguments', json_object('words', k), 'call_id', id, 'extra', json_object('type', 'function'), 'kind', 'call', 'name', 'count', 'role', role, 'turn', turn) AS VARCHAR) END
  FROM t WHERE role = 'assistant'
  UNION ALL
  SELECT conv_id, logged, 'tool', 'result', id, true, '', CASE WHEN logged < turn THEN turn ELSE logged END, CASE WHEN logged < turn THEN 1 ELSE 0 END, CASE WHEN logged < turn THEN 1 ELSE 0 END,
    cast(json_object('call_id', id, 'kind', 'result', 'result', json_object('n', turn), 'role', 'tool', 'turn', logged) AS VARCHAR) FROM g
  UNION ALL
  SELECT conv_id, turn, 'tool', 'result', 'x' || turn, false, 'no call', turn, 0, 0,
    cast(json_object('call_id', 'x' || turn, 'kind', 'result', 'result', '?', 'role', 'tool', 'turn', turn) AS VARCHAR) FROM t WHERE role = 'user' AND turn % 6 = 4
)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY o_turn, o_part, o_after, turn, kind, call_id NULLS FIRST, json) - 1 AS seq, role, kind, call_id, linked, problem, json FROM l
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op3_ngram_join": OP3, "op5_url_rules": OP5, "op7_mixing": OP7, "op9_chat_format": OP9}
