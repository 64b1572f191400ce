"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from .license_scan import TEMPLATES

SQL: dict[str, str] = {}

SQL["op6_line_dedup"] = """
WITH lines AS (
  SELECT row_id, doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
       unnest(range(1, len(parts) + 1)) AS t(i), LATERAL (SELECT parts[i] AS line)
), often AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_id) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN often o USING (key)
GROUP BY row_id
"""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

# Every pair of documents with a common shingle, then components by a recursive walk.
SQL["op10_near_duplicates"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w
), texts AS (
  SELECT min(doc_id) AS id, list_sort(s) AS s FROM sets GROUP BY list_sort(s)
), items AS (
  SELECT id, len(s) AS n, unnest(s) AS x FROM texts
), pairs AS (
  SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.x = b.x AND a.id < b.id
  WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), reach(id, r) AS (
  SELECT id, id FROM texts UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r
), class AS (
  SELECT id, min(r) AS component_id FROM reach GROUP BY id
)
SELECT doc_id, len(sets.s) AS n_shingles,
       CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id,
       CASE WHEN len(sets.s) = 0 THEN true ELSE doc_id = component_id END AS kept
FROM sets JOIN texts ON list_sort(sets.s) = texts.s JOIN class USING (id)
"""


def _containment_sql(items: str, item_id: str, more: str = "") -> str:
    """Best window of every document and item, by exact counts over all windows; the whole
    document where no window reaches the threshold."""
    return f"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents
), listed AS (
  SELECT *, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {items}
), wide AS (
  SELECT *, least(len(w), 5) AS width,
    list_distinct(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s
  FROM listed WHERE len(w) > 0
), item AS (
  SELECT {item_id}{more}, width, len(s) AS size, CAST(pow(2, ceil(log2(len(w) - width + 1))) AS BIGINT) AS unit, unnest(s) AS x FROM wide
), widths AS (
  SELECT DISTINCT width FROM item
), hits AS (
  SELECT DISTINCT doc_id, width, i - 1 AS pos, array_to_string(w[i:i + width - 1], ' ') AS x
  FROM docs, widths, LATERAL (SELECT unnest(range(1, len(w) - width + 2)) AS i)
  WHERE array_to_string(w[i:i + width - 1], ' ') IN (SELECT x FROM item)
), windows AS (
  SELECT {item_id}{more}, doc_id, size, t.win, count(DISTINCT x) / size AS containment, min(pos) AS first_word, max(pos + width - 1) AS last_word
  FROM hits JOIN item USING (width, x), LATERAL (SELECT unnest([pos // unit - 1, pos // unit, -2]) AS win) t
  GROUP BY {item_id}{more}, doc_id, size, t.win HAVING count(DISTINCT x) / size >= 0.75
)
SELECT doc_id, {item_id}{more}, containment, CAST(first_word AS INT) AS first_word, CAST(last_word AS INT) AS last_word FROM windows
QUALIFY row_number() OVER (PARTITION BY doc_id, {item_id} ORDER BY win = -2, containment DESC, win) = 1
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL["op9_decontamination"] = _containment_sql("benchmark", "item_id")
SQL["op1_license_scan"] = _containment_sql(
    "(VALUES " + ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(TEMPLATES))
    + ") AS t(template_id, license, text)", "template_id", ", license")

SQL["op8_phrase_dedup"] = f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents
), phrases AS (
  SELECT r, doc_id, i, w[i:i + 12] AS p FROM w, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i)
), late AS (
  SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY p) AS first FROM phrases) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT r, i + k AS i FROM late, range(13) AS t(k)
)
SELECT doc_id, len(any_value(w)) AS n_words, count(gone.i) AS n_removed,
       sha256(coalesce(string_agg(w[j], ' ' ORDER BY j) FILTER (WHERE gone.i IS NULL AND j > 0), '')) AS kept_sha256
FROM (SELECT r, doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [0] ELSE range(1, len(w) + 1) END) AS j FROM w) x
LEFT JOIN gone ON gone.r = x.r AND gone.i = x.j
GROUP BY x.r, doc_id
"""

CRC_TABLE_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

# Every row and state keeps its cheapest edits (cost, audit, repaired lines) in a recursive walk.
SQL["op11_conversation_repair"] = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), faulty AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, k: {CRC_TABLE_STEP})), 4294967295) % 20 AS fault FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS again FROM faulty WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged
), judged AS (
  SELECT conv_id, i, turn, role, text, left(role, 1) AS initial,
    CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM placed
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE illegal) AS illegal FROM judged GROUP BY conv_id
), forward(state, next, role) AS (
  VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')
), moves(state, initial, next, letter, price, role) AS (
  SELECT state, '*', state, 'D', 4, NULL FROM forward UNION ALL SELECT state, '+', next, 'R', 3, role FROM forward
  UNION ALL VALUES (0, 's', 1, 'K', 0, NULL), (0, 'u', 2, 'K', 0, NULL), (1, 'u', 2, 'K', 0, NULL), (2, 'a', 3, 'K', 0, NULL), (3, 'u', 2, 'K', 0, NULL)
), inserts(state, next, edits, price, lines) AS (
  SELECT state, state, '', 0, []::VARCHAR[] FROM forward UNION ALL SELECT state, next, 'I', 3, [role || ':'] FROM forward
  UNION ALL SELECT a.state, b.next, 'II', 6, [a.role || ':', b.role || ':'] FROM forward a JOIN forward b ON b.state = a.next
), walk(conv_id, i, state, best) AS (
  SELECT c.conv_id, CAST(0 AS BIGINT), s.next, {{'cost': s.price, 'audit': s.edits, 'lines': s.lines}} FROM counts c, inserts s WHERE s.state = 0
  UNION ALL
  SELECT conv_id, i, state, min(best) FROM (
    SELECT j.conv_id, j.i, s.next AS state,
      {{'cost': w.best.cost + m.price + s.price + CASE WHEN j.fault = 'truncated' AND m.letter <> 'D' THEN 3 ELSE 0 END,
        'audit': w.best.audit || m.letter || s.edits,
        'lines': list_concat(w.best.lines, CASE WHEN m.letter = 'D' THEN []::VARCHAR[] ELSE [coalesce(m.role, j.role) || ':' || j.text] END, s.lines)}} AS best
    FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
    JOIN moves m ON m.state = w.state AND (m.initial IN ('*', '+') OR m.initial = j.initial) AND (m.letter = 'D' OR j.fault NOT IN ('blank', 'duplicate'))
    JOIN inserts s ON s.state = m.next)
  GROUP BY conv_id, i, state
), final AS (
  SELECT c.*, min(w.best) AS best FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n AND w.state IN (0, 3) GROUP BY ALL
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(f.best.cost, 0) AS BIGINT) AS cost, coalesce(f.best.audit, '') AS audit,
  sha256(coalesce(array_to_string(f.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN final f ON a.conv_id IS NOT DISTINCT FROM f.conv_id
"""
