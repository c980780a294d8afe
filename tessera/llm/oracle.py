"""SQL for the pN_ queries that SQL can express, written apart from the operators and run by DuckDB on the same tables.

Left to tests instead: token ids and totals (p3, p8), a fitted model (p10), hash-ordered draws and splits (p2_split, p6_sample),
pieces (p1_pieces), and reports with tolerances (p7_overlap, p9_leaks).
"""

from __future__ import annotations


def _key(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _words(c: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


_WS = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _big(c: str) -> str:
    return f"(length({c}) > 3000 OR len(list_filter(string_split_regex({c}, '{_WS}'), lambda w: w <> '')) > 350)"


def _split(c: str) -> str:
    s = rf"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"
    return f"CASE WHEN {s} IN ('train','training') THEN 'train' WHEN {s} IN ('val','valid','validation','dev') THEN 'validation' WHEN {s} = 'test' THEN 'test' END"


_LATEST = "u AS (SELECT * FROM unified_samples WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)"

_HOLDS = f"""
WITH {_LATEST},
r AS (SELECT id, {_key("metadata.dialogue_id")} AS dialogue_key, metadata.turn_id AS turn_id, query, response FROM u),
ok AS (
  SELECT dialogue_key, min(turn_id) AS first_turn FROM r WHERE dialogue_key IS NOT NULL AND dialogue_key <> ''
  GROUP BY dialogue_key
  HAVING bool_and(turn_id IS NOT NULL AND {_key("coalesce(query, '')")} <> '' AND {_key("coalesce(response, '')")} <> '')
    AND min(turn_id) IN (0, 1) AND count(DISTINCT turn_id) = count(*) AND max(turn_id) - min(turn_id) + 1 = count(*))
"""

_PAIRS = f"""
WITH {_LATEST},
k AS (SELECT {_key("source")} AS sk, source AS canon FROM source_catalog),
recs AS (
  SELECT 'query' AS kind, id, {_split("split")} AS split, {_key("metadata.source")} AS sk, query AS text FROM u
  UNION ALL
  SELECT 'content', ft_id, {_split("split")}, {_key("source")}, m.content
  FROM (SELECT ft_id, split, source, unnest(messages) AS m FROM ft_samples) WHERE m.role = 'user'),
sets AS (SELECT row_number() OVER () AS rid, kind, id, split, coalesce(k.canon, 'unknown') AS source, list_distinct({_words("text")}) AS w
         FROM recs LEFT JOIN k USING (sk) WHERE split IS NOT NULL),
tok AS (SELECT rid, kind, split = 'train' AS is_train, len(w) AS n, unnest(w) AS word FROM sets),
shared AS (SELECT a.rid AS ta, b.rid AS eb, a.n AS na, b.n AS nb, count(*) AS i FROM tok a JOIN tok b
           ON a.kind = b.kind AND a.word = b.word AND a.is_train AND NOT b.is_train GROUP BY ALL),
pairs AS (SELECT x.kind, x.id AS tid, y.id AS eid, y.split, y.source FROM shared s
          JOIN sets x ON x.rid = s.ta JOIN sets y ON y.rid = s.eb WHERE 5 * i >= 4 * (na + nb - i) AND x.id <> y.id)
"""


_FORMS = f"""
WITH {_LATEST},
texts AS (
  SELECT 'kb' AS tbl, kb_id AS id, {_key("text")} AS form, {_key("text")} AS q FROM kb
  UNION ALL
  SELECT 'unified_samples', id, {_key("query")} || chr(2) || coalesce(array_to_string(list_sort(list_transform(context.documents,
    lambda d: 'k' || coalesce({_key("d.text")}, ''))), chr(1)), ''), {_key("query")} FROM u),
valid AS (SELECT raw_id AS id, payload::JSON AS j FROM raw_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
tree AS (SELECT v.id, t.fullkey, t.type, t.value FROM valid v, json_tree(v.j) t),
payloads AS (
  SELECT id, string_agg(fullkey || chr(3) || CASE WHEN type = 'VARCHAR' THEN 's' || {_key("(value ->> '$')")} WHEN type IN ('OBJECT', 'ARRAY') THEN type
    WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (value::VARCHAR::DOUBLE)::VARCHAR ELSE coalesce(value::VARCHAR, 'null') END, chr(1) ORDER BY fullkey, value::VARCHAR) AS form
  FROM tree GROUP BY id),
f AS (SELECT tbl, id, form FROM texts WHERE q <> '' UNION ALL SELECT 'raw_records', id, form FROM payloads)
"""

_HAVE = rf"""
WITH {_LATEST},
c AS (SELECT {_key("metadata.source")} AS sk, upper(regexp_replace(action, '^\s+|\s+$', '', 'g')) AS action, count(*) AS n FROM u GROUP BY ALL),
total AS (SELECT count(*) // 2 AS half FROM u),
have AS (SELECT t.source, t.action, t.target_share, t.min_rows, coalesce(sum(c.n), 0) AS n FROM mix_targets t
         LEFT JOIN c ON c.sk = {_key("t.source")} AND c.action = t.action GROUP BY ALL)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
WITH {_LATEST},
d AS (SELECT id, unnest(list_transform(context.documents, lambda x, i: {{'pos': i - 1, 'text': x.text}})) AS d FROM u)
SELECT 'kb' AS tbl, kb_id AS item_id, 0::INTEGER AS doc_pos FROM kb WHERE {_big("text")}
UNION ALL SELECT 'unified_samples', id, d.pos::INTEGER FROM d WHERE {_big("d.text")}""",
        "p2_found": rf"""
WITH RECURSIVE {_LATEST},
k AS (SELECT id, {_key("metadata.dialogue_id")} AS dk, lower(regexp_extract(id, '^(\p{{L}}+)', 1)) AS letters,
             regexp_extract(id, '([0-9]+)', 1) AS num FROM u),
t AS (SELECT id, 'd' || dk AS tie FROM k WHERE dk <> ''
      UNION SELECT id, 'o' || letters || '/' || (num::HUGEINT)::VARCHAR FROM k WHERE letters <> '' AND num <> ''),
e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM t a JOIN t b USING (tie)),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT a AS id, min(b) AS group_id FROM reach GROUP BY a HAVING count(*) > 1""",
        "p4_found": _FORMS
        + """, m AS (SELECT tbl, id, min(id) OVER (PARTITION BY tbl, form) AS first_id FROM f)
SELECT tbl, first_id, id AS other_id FROM m WHERE id <> first_id""",
        "p4_copies": _FORMS + "SELECT tbl, min(id) AS first_id, count(*) AS copies FROM f GROUP BY tbl, form",
        "p5_found": _HOLDS + "SELECT r.dialogue_key, (turn_id - first_turn + 1)::INTEGER AS turn_pos, id FROM r JOIN ok USING (dialogue_key)",
        "p5_messages": _HOLDS
        + """SELECT r.dialogue_key, (2 * (turn_id - first_turn) + p)::INTEGER AS message_pos, CASE p WHEN 1 THEN 'user' ELSE 'assistant' END AS role,
CASE p WHEN 1 THEN query ELSE response END AS content FROM r JOIN ok USING (dialogue_key), (VALUES (1), (2)) AS v(p)""",
        "p6_found": _HAVE + "SELECT source, action FROM have, total WHERE n < min_rows OR n < target_share * half",
        "p6_availability": _HAVE
        + """SELECT source, action, target_share * half AS target, n::BIGINT AS available, greatest(0, greatest(min_rows, ceil(target_share * half)::BIGINT) - n)::BIGINT AS unavailable,
n >= min_rows AND n >= target_share * half AS met FROM have, total""",
        "p7_found": _PAIRS + "SELECT DISTINCT kind, least(tid, eid) AS left_id, greatest(tid, eid) AS right_id FROM pairs",
        "p7_links": _PAIRS
        + """, ends AS (SELECT kind, tid AS id FROM pairs UNION ALL SELECT kind, eid FROM pairs), n AS (SELECT kind, id, count(*) AS links FROM ends GROUP BY ALL)
SELECT s.kind, s.id, min(s.id) OVER (PARTITION BY s.kind, list_sort(s.w)) AS class_id, coalesce(links, 0) AS links FROM sets s LEFT JOIN n USING (kind, id) WHERE len(s.w) > 0""",
        "p7_counts": _PAIRS + "SELECT kind, split, source, count(*) AS pairs, count(DISTINCT eid) AS records FROM pairs GROUP BY ALL",
        "p9_found": f"""
WITH i AS (SELECT item_id, {_words("text")} AS w FROM eval_items),
d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
iw AS (SELECT item_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i WHERE len(w) >= 12)),
dw AS (SELECT doc_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
    }
