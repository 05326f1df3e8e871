"""DuckDB text of the operators that SQL can say, written from their definitions: all pairs, and a state for each place, row by row."""

from __future__ import annotations

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
 AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98 END),
reach AS (SELECT r, r AS t FROM v UNION SELECT reach.r, p.b FROM reach JOIN pairs p ON reach.t = p.a),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.t GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM pairs p WHERE p.a = v.r) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN least USING (r)
"""

BIT = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
BYTE = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {BIT})"
CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: {BYTE}), 4294967295)"


def _plus(way: str, price: str, letter: str, line: str | None = None) -> str:
    text = f"{way}.text" if line is None else f"CASE WHEN {way}.text = '' THEN {line} ELSE {way}.text || chr(10) || {line} END"
    return f"{{'cost': {way}.cost + {price}, 'audit': {way}.audit || '{letter}', 'text': {text}}}"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


NEVER = "{'cost': CAST(1000000 AS BIGINT), 'audit': '', 'text': ''}"
USER, ASSISTANT = "'user:'", "'assistant:'"
# Rows may be put in before each row and at the end; two are enough, as four states are.
IN_2 = _least("w2", _plus("w0", "2", "I", USER), _plus("w1", "2", "I", USER), _plus("w3", "2", "I", USER))
IN_3 = _least("w3", _plus("w2", "2", "I", ASSISTANT))
IN_33 = _least("x3", _plus("x2", "2", "I", ASSISTANT))
STAY = "fault NOT IN ('blank', 'duplicate')"
T = "CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END"


def _taken(way: str, initial: str, role: str) -> str:
    kept, changed = _plus(way, T, "K", "role || ':' || text"), _plus(way, f"2 + {T}", "R", f"'{role}:' || text")
    return f"CASE WHEN {STAY} THEN CASE WHEN left(role, 1) = '{initial}' THEN {kept} ELSE {changed} END ELSE {NEVER} END"


REPAIR = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
k AS (SELECT *, {CRC} % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, role0, text0, copy, CASE WHEN kind = 4 THEN 'user' ELSE role0 END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text
 FROM k, (VALUES (0), (1)) x(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, text0, copy) AS pos, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS rest FROM d),
f AS (SELECT *, CASE WHEN rest = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(rest, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
 left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS step FROM p),
ids AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'text': ''}} AS w0, {NEVER} AS w1, {NEVER} AS w2, {NEVER} AS w3 FROM ids
 UNION ALL SELECT conv_id, pos, {_least(_plus("w0", "3", "D"))}, {_least(_plus("w1", "3", "D"), f"CASE WHEN {STAY} AND left(role, 1) = 's' THEN " + _plus("w0", T, "K", "role || ':' || text") + f" ELSE {NEVER} END")},
  {_least(_plus("y2", "3", "D"), _taken("w0", "u", "user"), _taken("w1", "u", "user"), _taken("y3", "u", "user"))}, {_least(_plus("y3", "3", "D"), _taken("y2", "a", "assistant"))}
 FROM (SELECT z.*, {IN_33} AS y3, x2 AS y2 FROM (SELECT walk.conv_id, f.pos, w0, w1, {IN_2} AS x2, {IN_3} AS x3, role, text, fault FROM walk JOIN f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.pos = walk.pos + 1) z)),
last AS (SELECT conv_id, w0, w1, {IN_2} AS x2, {IN_3} AS x3 FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
best AS (SELECT conv_id, {_least("w0", "y3")} AS w FROM (SELECT *, {IN_33} AS y3 FROM last)),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (step IS NOT NULL AND step NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 w.cost AS cost, w.audit AS audit, sha256(w.text) AS repaired_sha256 FROM best b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id
"""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_COPIES = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [hash(array_to_string(ws, ' '))]
 ELSE list_transform(range(1, len(ws) - 3), lambda i: hash(array_to_string(ws[i:i + 4], ' '))) END) AS s FROM d),
n AS (SELECT r, doc_id, len(s) AS n FROM s),
u AS (SELECT r, unnest(s) AS t FROM s),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM u a JOIN u b ON a.t = b.t AND a.r <> b.r GROUP BY 1, 2),
pairs AS (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT r, r AS t FROM n UNION SELECT reach.r, p.b FROM reach JOIN pairs p ON reach.t = p.a)
SELECT n.doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id FROM reach JOIN n ON n.r = reach.r JOIN n o ON o.r = reach.t GROUP BY n.r, n.doc_id
"""

WORDS = f"regexp_extract_all(coalesce({LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS t FROM (SELECT item_id, ws, least(13, len(ws)) AS m, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, m, i, array_to_string(ws[i:i + m - 1], ' ') AS t FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d JOIN sizes ON len(ws) >= m)),
found AS (SELECT r, dw.m, i, item_id FROM dw JOIN bw ON bw.m = dw.m AND bw.t = dw.t),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, m, i FROM found)) GROUP BY 1),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
