"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, coalesce(length(text), 0) AS n FROM conversations),
call AS (
  SELECT conv_id, turn AS seq, 'call_' || turn AS call_id, ['search', 'lookup', 'summarise', 'forecast'][CAST(n % 4 + 1 AS INT)] AS name, n, CAST(to_json(coalesce(text, '')) AS VARCHAR) AS query,
         CASE WHEN n % 3 = 0 THEN 'call_' || (turn - 2) WHEN n % 8 = 1 THEN 'call_' || (turn + 2) END AS dep
  FROM t WHERE role = 'assistant'),
result AS (
  SELECT conv_id, 'call_' || (turn - 1) AS call_id, arg_min(text, turn) AS content, count(*) AS n_results FROM t WHERE role = 'user' AND turn > 0 GROUP BY ALL),
edge AS (SELECT c.conv_id, c.call_id, c.dep, c.seq, d.seq AS dep_seq FROM call c LEFT JOIN call d ON c.conv_id = d.conv_id AND c.dep = d.call_id WHERE c.dep IS NOT NULL),
disordered AS (SELECT DISTINCT conv_id FROM edge WHERE dep_seq > seq),
level AS (
  SELECT c.conv_id, c.call_id, 0 AS stage FROM call c LEFT JOIN edge e ON c.conv_id = e.conv_id AND c.call_id = e.call_id AND e.dep_seq IS NOT NULL WHERE e.call_id IS NULL
  UNION ALL
  SELECT e.conv_id, e.call_id, l.stage + 1 FROM level l JOIN edge e ON l.conv_id = e.conv_id AND e.dep = l.call_id),
judged AS (
  SELECT c.*, CASE WHEN d.conv_id IS NULL THEN 0 ELSE l.stage END AS stage, e.call_id IS NOT NULL AND e.dep_seq IS NULL AS unmet,
    CASE WHEN n % 13 = 0 THEN NULL
         WHEN n % 11 = 0 THEN '{"max_words":' || n || '}'
         WHEN n % 7 = 0 THEN '{"max_words":' || n || ',"query":5}'
         WHEN n % 5 = 0 THEN '{"max_words":' || n || ',"tone":[1,{"a":true,"b":null}]}'
         ELSE '{"max_words":' || n || ',"query":' || query || '}' END AS arguments,
    CASE WHEN n % 13 = 0 THEN ['malformed']
         WHEN n % 4 = 3 THEN ['unknown_tool']
         WHEN n % 11 = 0 THEN CASE WHEN n % 4 = 2 THEN [] ELSE ['missing:query'] END
         WHEN n % 7 = 0 THEN ['type:query']
         WHEN n % 5 = 0 THEN CASE WHEN n % 4 = 2 THEN ['unexpected:tone'] ELSE ['missing:query', 'unexpected:tone'] END
         ELSE [] END AS wrong
  FROM call c LEFT JOIN disordered d USING (conv_id) LEFT JOIN level l ON c.conv_id = l.conv_id AND c.call_id = l.call_id
  LEFT JOIN edge e ON c.conv_id = e.conv_id AND c.call_id = e.call_id),
linked AS (
  SELECT coalesce(j.conv_id, r.conv_id) AS conv_id, coalesce(j.call_id, r.call_id) AS call_id, j.seq, j.name, j.stage, coalesce(r.n_results, 0) AS n_results, j.arguments, r.content,
    CASE WHEN j.call_id IS NULL THEN 'no_call' ELSE array_to_string(list_sort(list_concat(wrong, CASE WHEN j.stage IS NULL THEN ['cycle'] ELSE [] END,
      CASE WHEN r.call_id IS NULL THEN ['no_result'] ELSE [] END, CASE WHEN unmet THEN ['unmet_dependency'] ELSE [] END)), ',') END AS errors
  FROM judged j FULL JOIN result r ON j.conv_id = r.conv_id AND j.call_id = r.call_id)
SELECT conv_id, call_id, seq, name, stage, n_results, errors, errors = '' AS valid,
  '{"arguments":' || coalesce(arguments, 'null') || ',"call_id":"' || call_id || '","conv_id":' || conv_id || ',"name":' || coalesce('"' || name || '"', 'null')
  || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS json
FROM linked
"""

_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
item AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
size AS (SELECT DISTINCT size FROM item),
win AS (
  SELECT doc_id, i, 10 AS size, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS win FROM word
  UNION ALL
  SELECT d.doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') FROM d, size, unnest(range(1, len(w) + 1)) AS u(k) WHERE size < 10),
hit AS (SELECT w.doc_id, w.i, w.size, item_id FROM win w JOIN item USING (size, win)),
place AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN place USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(w[i : i + least(len(w), 3) - 1], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b WHERE 100 * c >= 90 * (m.n + k.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

OP10 = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS place FROM pages),
r AS (SELECT page_id, CASE WHEN place > 0 THEN substr(url, place + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rule(rule_host, rule_path, rule_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM h JOIN rule ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
l AS (SELECT *, regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)(\.|$)') AS listed FROM h)
SELECT page_id, host, path, rule, listed, coalesce(rule_verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM l LEFT JOIN fit USING (page_id)
"""

# CRC-32 by its table, which follows from the polynomial; DuckDB has no function for it
_CRC_TABLE = "crc(t) AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) FROM range(256) r(i))"
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def _add(cell: str, cost: str, letter: str, piece: str) -> str:
    """A cell after one more edit: its cost in nine digits and its audit, so that the least string is the cheapest and least; and the repaired turns."""
    return f"CASE WHEN {cell} IS NOT NULL THEN {{'k': lpad(CAST(CAST(left({cell}.k, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({cell}.k, 10) || '{letter}', 'x': {cell}.x || {piece}}} END"


def _least(*cells: str) -> str:
    return f"list_sort(list_filter([{', '.join(cells)}], lambda c: c IS NOT NULL))[1]"


_NEW_USER, _NEW_ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_INSERTED = f"""
SELECT *, {_least("ca", _add("cu1", "3", "I", _NEW_ASSISTANT))} AS ca1 FROM (
  SELECT *, {_least("cu", _add("c0", "3", "I", _NEW_USER), _add("cs", "3", "I", _NEW_USER), _add("ca", "3", "I", _NEW_USER))} AS cu1 FROM walk)"""


def _stays(cell: str, letter: str, cost: str, when: str, said: str) -> str:
    return f"CASE WHEN fault NOT IN ('b', 'd') AND {when} THEN {_add(cell, cost + ' + CASE WHEN fault = ' + chr(39) + 't' + chr(39) + ' THEN 3 ELSE 0 END', letter, said)} END"


_KEPT = "chr(10) || role || ':' || text"
_TO_USER = [x for cell in ("c0", "cs", "ca1") for x in (_stays(cell, "K", "0", "ini = 'u'", _KEPT), _stays(cell, "R", "3", "true", _NEW_USER + " || text"))]
_TO_ASSISTANT = [_stays("cu1", "K", "0", "ini = 'a'", _KEPT), _stays("cu1", "R", "3", "true", _NEW_ASSISTANT + " || text")]

OP11 = rf"""
WITH RECURSIVE {_CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE kind > 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM d),
f AS (SELECT *, left(role, 1) AS ini, CASE WHEN last = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM r),
none AS (SELECT CAST(NULL AS STRUCT(k VARCHAR, x VARCHAR)) AS c),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'k': '000000000', 'x': ''}} AS c0, c AS cs, c AS cu, c AS ca FROM (SELECT DISTINCT conv_id FROM f), none
  UNION ALL
  SELECT w.conv_id, f.i, {_add("c0", "4", "D", "''")}, {_least(_add("cs", "4", "D", "''"), _stays("c0", "K", "0", "ini = 's'", _KEPT))},
    {_least(_add("cu1", "4", "D", "''"), *_TO_USER)}, {_least(_add("ca1", "4", "D", "''"), *_TO_ASSISTANT)}
  FROM ({_INSERTED}) w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1),
last_i AS (SELECT conv_id, max(i) AS i FROM f GROUP BY conv_id),
best AS (SELECT w.conv_id, {_least("c0", "ca1")} AS c FROM ({_INSERTED}) w JOIN last_i l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i),
pair AS (SELECT conv_id, ini || lead(ini) OVER (PARTITION BY conv_id ORDER BY i) AS two FROM f),
ill AS (SELECT conv_id, count(*) AS illegal FROM pair WHERE two NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated FROM f GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(c.k, 9) AS BIGINT), 0) AS cost, coalesce(substr(c.k, 10), '') AS audit, sha256(coalesce(substr(c.x, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ill ON ill.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""
OP12 = rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce({_CRC.format("CAST(doc_id AS VARCHAR)")}, 1) AS h FROM documents, crc),
e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
p AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM e),
m AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM p),
word AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM m),
same AS (SELECT x.doc_id, x.i, x.i - y.i AS q FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i < x.i AND 3 * (x.i - y.i) <= x.n),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretch AS (SELECT doc_id, q, min(i) - q AS s, count(*) + q AS len FROM island GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
run AS (SELECT * FROM stretch x WHERE NOT EXISTS (SELECT 1 FROM stretch y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM run GROUP BY doc_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len / q DESC, s, q) AS place FROM run) WHERE place = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM m LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op1_tool_calls": OP1, "op2_decontaminate": OP2, "op6_jaccard_join": OP6, "op10_url_cascade": OP10, "op11_structure_repair": OP11, "op12_periodic_runs": OP12}
