"""Independent DuckDB SQL for the registered queries (the correctness oracle).

Written from the operator contracts, not generated from the Spark plans. The
tables are the driver's views. Hash draws and whitespace classes use the
portable forms documented in ``functions/hashing.py`` and ``functions/text.py``.
"""

from __future__ import annotations

from ..operators import annotate as A
from ..operators import prompt as P
from ..operators import rules as R
from . import catalog as C

SEED = C.SEED
# DuckDB (RE2) form of the whitespace class.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


def no_space(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', '', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def u32(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{SEED}', {', '.join(parts)})), 1, 8))::BIGINT"


def okey(*keys: str, seed=SEED) -> str:
    return f"sha1(concat_ws('|', '{seed}', {', '.join(keys)}))"


def SRC_POS() -> str:
    return "(conv_id * 1048576 + turn)"


CLEAN_Q = f"""
SELECT min(src_pos) AS src_pos, text FROM (
  SELECT {SRC_POS()} AS src_pos, {collapse('text')} AS text FROM conversations WHERE role = 'user'
) WHERE text IS NOT NULL AND length(text) > 0 GROUP BY text"""

LABELLED = """
SELECT d.doc_id, d.text, 'Q' || CAST(l.quality AS VARCHAR) || '_T' || CAST(l.toxic AS VARCHAR) AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def rule_case(rules, text: str = "lower(text)") -> str:
    arms = []
    for _, kws, lab in sorted(rules, key=lambda r: r[0]):
        cond = " OR ".join(f"contains({text}, {q(k.lower())})" for k in kws)
        arms.append(f"WHEN {cond} THEN {q(lab)}")
    return "CASE " + " ".join(arms) + " ELSE NULL END"


def rule_scored(src: str, key: str, rules, labels, extra: str = "") -> str:
    """SQL producing ``key, [extra], intent, confidence`` for rows of ``src``
    (which must have ``text``); also exposes per-label ``label, prob`` rows
    through the CTE name ``rs_long``."""
    n = len(labels)
    lo, hi = R.other_range(n)
    lab_list = "[" + ", ".join(q(x) for x in labels) + "]"
    lab_rows = ", ".join(f"({i}, {q(x)})" for i, x in enumerate(labels))
    return f"""
rs_src AS ({src}),
rs_m AS (SELECT *, {rule_case(rules)} AS rule_label, sha1(text) AS h FROM rs_src),
rs_i AS (SELECT *, coalesce(rule_label, {lab_list}[({u32('h', "'fallback'")} % {n}) + 1]) AS intent FROM rs_m),
rs_raw AS (
  SELECT rs_i.*, l.idx, l.label,
         CASE WHEN l.label = rs_i.intent
              THEN {R.WIN_LO} + ({u32('h', "'p' || CAST(l.idx AS VARCHAR)")} % {R.WIN_HI - R.WIN_LO + 1})
              ELSE {lo} + ({u32('h', "'p' || CAST(l.idx AS VARCHAR)")} % {hi - lo + 1}) END AS r
  FROM rs_i CROSS JOIN (VALUES {lab_rows}) AS l(idx, label)),
rs_tot AS (SELECT *, sum(r) OVER (PARTITION BY {key}) AS tot FROM rs_raw),
rs_long AS (SELECT *, CAST(floor((r * 20000 + tot) / (tot * 2)) AS DOUBLE) / 10000.0 AS prob FROM rs_tot),
rs AS (SELECT {key}, {extra} intent, prob AS confidence FROM rs_long WHERE label = intent)"""


def lang_scored() -> str:
    return rule_scored("SELECT doc_id, text, lang AS y FROM documents", "doc_id", C.LANG_RULES,
                       C.LANG_LABELS, extra="y,")


def question_scored() -> str:
    return rule_scored(CLEAN_Q, "src_pos", R.REFERENCE_RULES, R.REFERENCE_LABELS)


def _per_class(pairs_cte: str) -> str:
    return f"""
conf AS (SELECT y, pred, count(*) AS n FROM {pairs_cte} GROUP BY y, pred),
cls AS (SELECT y AS label FROM conf UNION SELECT pred FROM conf),
tr AS (SELECT y AS label, CAST(sum(n) AS BIGINT) AS support,
              CAST(sum(CASE WHEN y = pred THEN n ELSE 0 END) AS BIGINT) AS tp FROM conf GROUP BY y),
gu AS (SELECT pred AS label, CAST(sum(n) AS BIGINT) AS n_pred FROM conf GROUP BY pred),
pc0 AS (SELECT cls.label, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(support, 0) AS support
        FROM cls LEFT JOIN tr ON cls.label = tr.label LEFT JOIN gu ON cls.label = gu.label),
pc AS (SELECT label, tp, n_pred - tp AS fp, support - tp AS fn, support,
              CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
              CASE WHEN 2 * tp + (n_pred - tp) + (support - tp) > 0
                   THEN 2 * tp / (2 * tp + (n_pred - tp) + (support - tp)) ELSE 0.0 END AS f1
       FROM pc0)"""


# Mean confidence at six places, half up, of confidences with four places, in whole numbers.
EXACT_MEAN = "(200 * sum(CAST(round(confidence * 10000) AS BIGINT)) + count(*)) // (2 * count(*)) / 1000000.0"
LANG_PAIRS = "lp AS (SELECT doc_id, y, intent AS pred, confidence FROM rs)"


def _stratified(src: str) -> str:
    """CTEs ending in ``st(doc_id, label, split)``: the 80/10/10 quota split."""
    return f"""
sd AS ({src}),
sp AS (SELECT count(*) AS n, count(*) - CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT) AS n_train,
              CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT) AS hold FROM sd),
sp2 AS (SELECT *, hold - CAST(ceil(0.5::DOUBLE * hold) AS BIGINT) AS dev_total FROM sp),
sc AS (SELECT label, count(*) AS n_c FROM sd GROUP BY label),
a1 AS (SELECT sc.label, n_c, (n_c * n_train) // n AS base, (n_c * n_train) % n AS rem, n_train FROM sc, sp2),
a2 AS (SELECT *, n_train - sum(base) OVER () AS lft, row_number() OVER (ORDER BY rem DESC, label) AS pos FROM a1),
q1 AS (SELECT label, n_c, base + CASE WHEN pos <= lft THEN 1 ELSE 0 END AS train_c FROM a2),
b1 AS (SELECT q1.label, train_c, n_c - train_c AS hold_c, dev_total, hold FROM q1, sp2),
b2 AS (SELECT *, (hold_c * dev_total) // hold AS base, (hold_c * dev_total) % hold AS rem FROM b1),
b3 AS (SELECT *, dev_total - sum(base) OVER () AS lft, row_number() OVER (ORDER BY rem DESC, label) AS pos FROM b2),
qt AS (SELECT label, train_c, base + CASE WHEN pos <= lft THEN 1 ELSE 0 END AS dev_c FROM b3),
rk AS (SELECT sd.*, row_number() OVER (PARTITION BY label ORDER BY {okey('doc_id')}, doc_id) AS r FROM sd),
st AS (SELECT rk.*, CASE WHEN r <= train_c THEN 'train' WHEN r <= train_c + dev_c THEN 'dev' ELSE 'test' END AS split
       FROM rk JOIN qt ON rk.label = qt.label)"""


GROUP_SPLIT = f"""
gd AS (SELECT doc_id, text, source AS label, {no_space(strip('text'))} AS norm_text FROM documents),
dd AS (SELECT norm_text, label, min(doc_id) AS doc_id FROM gd GROUP BY norm_text, label),
gv AS (SELECT norm_text, label, count(*) AS v FROM gd GROUP BY norm_text, label),
gg AS (SELECT norm_text, label AS group_label FROM (
        SELECT *, row_number() OVER (PARTITION BY norm_text ORDER BY v DESC, label) AS rn FROM gv) WHERE rn = 1),
gr AS (SELECT norm_text, group_label,
              row_number() OVER (PARTITION BY group_label ORDER BY {okey('norm_text')}, norm_text) AS rk FROM gg),
gs AS (SELECT dd.doc_id, dd.label, gr.group_label, dd.norm_text, (rk - 1) % 5 AS fold,
              CASE WHEN (rk - 1) % 5 = 0 THEN 'dev' ELSE 'train' END AS split
       FROM dd JOIN gr ON dd.norm_text = gr.norm_text)"""


def _sanitize(id_expr: str, name_expr: str) -> str:
    kept = f"regexp_replace(upper(CAST({id_expr} AS VARCHAR)), '[^A-Z0-9_]', '', 'g')"
    return (f"CASE WHEN coalesce(length({kept}), 0) > 0 THEN {kept} "
            f"ELSE upper(substr(md5(coalesce(CAST({name_expr} AS VARCHAR), '')), 1, 8)) END")


URL_NO_ALNUM = "regexp_replace(url, '[A-Za-z0-9]', '', 'g')"

ORACLES = {
    "clean_dedup_questions": CLEAN_Q,
    "rule_intent_counts": f"WITH {question_scored()} SELECT intent, count(*) AS count, "
                          f"{EXACT_MEAN} AS mean_confidence FROM rs GROUP BY intent",
    "rule_score_questions": f"WITH {question_scored()} SELECT src_pos, intent, confidence FROM rs",
    "rule_many_keywords": """WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS keyword FROM benchmark)
        SELECT doc_id, 'HAS_' || min(keyword) AS rule_label FROM documents LEFT JOIN k ON contains(lower(text), keyword) GROUP BY doc_id""",
    "rule_word_dictionary": """WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[^ \\t\\n]+')) AS keyword FROM documents)
        SELECT doc_id, min({'n': -length(keyword), 'label': 'HAS_' || keyword}).label AS rule_label
        FROM documents LEFT JOIN k ON contains(lower(text), keyword) GROUP BY doc_id""",
    "label_rows_with_words": """SELECT doc_id, lang FROM documents WHERE lang = 'de'
        AND (contains(lower(text), ' und ') OR contains(lower(text), ' oder ') OR contains(lower(text), ' the '))""",
    "rule_score_lang": f"WITH {lang_scored()} SELECT doc_id, intent, confidence FROM rs",
    "rule_probs_lang": f"WITH {lang_scored()} SELECT doc_id, label, prob FROM rs_long",
    "normalize_documents": f"""
SELECT doc_id, {collapse('text')} AS collapsed, {no_space('text')} AS no_space, {strip('text')} AS stripped,
       upper({strip('lang')}) AS lang_upper, substr(text, 1, 300) AS prefix300,
       greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) AS tokens, substr(text, 1, 256) AS trimmed64
FROM documents""",
    "dedup_documents": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text",
    "sanitize_ids": f"SELECT page_id, {_sanitize('url', 'html')} AS label_id, "
                    f"{_sanitize(URL_NO_ALNUM, 'url')} AS fallback_id FROM pages",
    "label_counts": f"SELECT label, count(*) AS count FROM ({LABELLED}) GROUP BY label",
    "label_pair_counts": "SELECT source AS label_id, lang AS label_name, count(*) AS count FROM documents "
                         "WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang",
    "conflicts_by_source": f"""
SELECT norm_text, count(*) AS n_labels, string_agg(label, ',' ORDER BY label) AS labels FROM (
  SELECT DISTINCT {no_space(strip('text'))} AS norm_text, source AS label FROM documents
) GROUP BY norm_text HAVING count(*) > 1""",
    "column_lengths_pages": """
SELECT 0 AS col_pos, 'page_id' AS col_name, avg(length(CAST(page_id AS VARCHAR))) AS mean_len FROM pages
UNION ALL SELECT 1, 'url', avg(length(url)) FROM pages
UNION ALL SELECT 2, 'html', avg(length(html)) FROM pages""",
    "detect_columns": """
WITH cand(rank, name) AS (VALUES (1, 'question'), (2, 'query'), (3, 'content'), (4, 'text'), (5, '用户提问'),
     (6, '提问'), (7, '问题'), (8, '内容'), (9, '标题'), (10, 'raw'), (11, 'msg')),
exact AS (
  SELECT table_name, arg_min(column_name, rank) AS column_name FROM information_schema.columns c
  JOIN cand ON lower(trim(c.column_name)) = cand.name
  WHERE table_name IN ('conversations', 'documents', 'pages', 'customer') GROUP BY table_name),
pl AS (SELECT 'page_id' AS c, 0 AS p, avg(length(CAST(page_id AS VARCHAR))) AS m FROM pages
       UNION ALL SELECT 'url', 1, avg(length(url)) FROM pages
       UNION ALL SELECT 'html', 2, avg(length(html)) FROM pages),
cl AS (SELECT 'c_custkey' AS c, 0 AS p, avg(length(CAST(c_custkey AS VARCHAR))) AS m FROM customer
       UNION ALL SELECT 'c_name', 1, avg(length(c_name)) FROM customer
       UNION ALL SELECT 'c_nationkey', 2, avg(length(CAST(c_nationkey AS VARCHAR))) FROM customer
       UNION ALL SELECT 'c_acctbal', 3, avg(length(CAST(c_acctbal AS VARCHAR))) FROM customer
       UNION ALL SELECT 'c_mktsegment', 4, avg(length(c_mktsegment)) FROM customer)
SELECT table_name, column_name, 'exact' AS rule FROM exact
UNION ALL SELECT 'pages', (SELECT c FROM pl ORDER BY m DESC, p LIMIT 1), 'longest'
WHERE 'pages' NOT IN (SELECT table_name FROM exact)
UNION ALL SELECT 'customer', (SELECT c FROM cl ORDER BY m DESC, p LIMIT 1), 'longest'
WHERE 'customer' NOT IN (SELECT table_name FROM exact)""",
    "stratified_split_labelled": f"WITH {_stratified(LABELLED)} SELECT doc_id, label, split FROM st",
    "split_sizes": f"WITH {_stratified(LABELLED)} SELECT split, label, count(*) AS count FROM st GROUP BY split, label",
    "prefix_split_by_source": f"""
WITH sc AS (SELECT source AS label, count(*) AS n_c FROM documents GROUP BY source),
rk AS (SELECT doc_id, source AS label,
              row_number() OVER (PARTITION BY source ORDER BY {okey('source', 'doc_id')}, doc_id) AS r FROM documents)
SELECT doc_id, rk.label, CASE WHEN r <= CAST(floor(n_c * 0.8::DOUBLE) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM rk JOIN sc ON rk.label = sc.label""",
    "group_split_by_source": f"WITH {GROUP_SPLIT} SELECT doc_id, label, group_label, fold, split FROM gs",
    "group_split_leak": f"""WITH {GROUP_SPLIT}
SELECT count(*) AS leaked_groups FROM (
  SELECT DISTINCT norm_text FROM gs WHERE split = 'train'
  INTERSECT SELECT DISTINCT norm_text FROM gs WHERE split = 'dev')""",
    "leak_audit": f"""
WITH {_stratified("SELECT doc_id, text, source AS label FROM documents")},
td AS (SELECT doc_id, label, split, {strip('text')} AS t, {no_space(strip('text'))} AS norm, split = 'dev' AS second FROM st WHERE split <> 'test'),
tk AS (SELECT * FROM td QUALIFY row_number() OVER (PARTITION BY norm, label ORDER BY second, doc_id) = 1),
tv AS (SELECT norm, label, count(*) AS v FROM td GROUP BY norm, label),
tg AS (SELECT norm, label AS g FROM tv QUALIFY row_number() OVER (PARTITION BY norm ORDER BY v DESC, label) = 1),
tf AS (SELECT norm, (row_number() OVER (PARTITION BY g ORDER BY {okey('norm')}, norm) - 1) % 5 = 0 AS dev FROM tg),
ts AS (SELECT tk.t, tk.norm, dev FROM tk JOIN tf USING (norm))
SELECT 'before' AS stage, 'conflicting_groups' AS measure, (SELECT count(*) FROM (SELECT norm FROM td GROUP BY norm HAVING count(DISTINCT label) > 1)) AS n
UNION ALL SELECT 'before', 'train_rows', (SELECT count(*) FROM td WHERE NOT second) UNION ALL SELECT 'before', 'dev_rows', (SELECT count(*) FROM td WHERE second)
UNION ALL SELECT 'before', 'texts_on_both_sides', (SELECT count(*) FROM (SELECT t FROM td WHERE second INTERSECT SELECT t FROM td WHERE NOT second))
UNION ALL SELECT 'after', 'leaked_groups', (SELECT count(*) FROM (SELECT norm FROM ts WHERE dev INTERSECT SELECT norm FROM ts WHERE NOT dev))
UNION ALL SELECT 'after', 'train_rows', (SELECT count(*) FROM ts WHERE NOT dev) UNION ALL SELECT 'after', 'dev_rows', (SELECT count(*) FROM ts WHERE dev)
UNION ALL SELECT 'after', 'texts_on_both_sides', (SELECT count(*) FROM (SELECT t FROM ts WHERE dev INTERSECT SELECT t FROM ts WHERE NOT dev))""",
    "log_row_numbers": """SELECT row_number() OVER (ORDER BY conv_id, turn) AS src_pos, conv_id, turn, sha1(text) AS text_sha1
FROM conversations WHERE role = 'user'""",
    "exact_overlap_train_dev": f"""
WITH {_stratified("SELECT doc_id, text, source AS label FROM documents")}
SELECT sha1(t) AS text_sha1, length(t) AS n_chars FROM (
  SELECT {strip('text')} AS t FROM st WHERE split = 'train'
  INTERSECT SELECT {strip('text')} FROM st WHERE split = 'dev')""",
    "eval_macro": f"""WITH {lang_scored()}, {LANG_PAIRS}, {_per_class('lp')}
SELECT round(a.accuracy, 6) AS accuracy, a.n, round(m.precision, 6) AS precision,
       round(m.recall, 6) AS recall, round(m.f1, 6) AS f1
FROM (SELECT count(*) AS n, avg(CASE WHEN y = pred THEN 1 ELSE 0 END) AS accuracy FROM lp) a,
     (SELECT avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM pc) m""",
    "eval_report": f"""WITH {lang_scored()}, {LANG_PAIRS}, {_per_class('lp')}
SELECT label AS row, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, round(avg(CASE WHEN y = pred THEN 1 ELSE 0 END), 4), count(*) FROM lp
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), sum(support) FROM pc
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4),
       round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4), sum(support) FROM pc""",
    "eval_confusion": f"""WITH {lang_scored()}, {LANG_PAIRS},
conf AS (SELECT y, pred, count(*) AS n FROM lp GROUP BY y, pred),
cls AS (SELECT y AS label FROM conf UNION SELECT pred FROM conf)
SELECT a.label AS y, b.label AS pred, coalesce(conf.n, 0) AS n
FROM cls a CROSS JOIN cls b LEFT JOIN conf ON conf.y = a.label AND conf.pred = b.label""",
    "eval_confidence": f"""WITH {lang_scored()}, {LANG_PAIRS}
SELECT pred AS label, count(*) AS n, {EXACT_MEAN} AS mean_confidence,
       round(avg(CASE WHEN confidence < 0.86 THEN 1 ELSE 0 END), 6) AS low_share FROM lp GROUP BY pred""",
    "eval_top_confusions": f"""WITH {lang_scored()}, {LANG_PAIRS}
SELECT y, pred, count(*) AS n FROM lp WHERE y <> pred GROUP BY y, pred ORDER BY n DESC, y, pred LIMIT 5""",
}


def _gen_cte() -> str:
    """Samples as rounds: each round gives one more combination to every template that
    still has one, until the region's customers are served."""
    return f"""
gv AS (SELECT slot, value, row_number() OVER (PARTITION BY slot ORDER BY {okey('value')}, value) - 1 AS val_idx FROM (
  SELECT 'type' AS slot, p_type AS value FROM part UNION SELECT 'brand', p_brand FROM part UNION SELECT 'supplier', s_name FROM supplier
  UNION SELECT 'priority', o_orderpriority FROM orders UNION SELECT 'segment', c_mktsegment FROM customer)),
gc AS (SELECT slot, count(*)::HUGEINT AS n FROM gv GROUP BY slot),
gf(form, s0, s1) AS (VALUES ('Which {{type}} parts does {{supplier}} ship to @?', 'type', 'supplier'), ('Is {{supplier}} the cheapest source of {{brand}} in @?', 'supplier', 'brand'),
  ('@: how are {{priority}} orders of the {{segment}} segment?', 'priority', 'segment'), ('Call the desk in @', NULL, NULL)),
gt AS (SELECT r_name AS label, replace(form, '@', n_name) AS template, s0, s1, coalesce(a.n, 1) AS n0, coalesce(a.n, 1) * coalesce(b.n, 1) AS combinations
  FROM nation JOIN region ON n_regionkey = r_regionkey, gf LEFT JOIN gc a ON a.slot = s0 LEFT JOIN gc b ON b.slot = s1),
gn AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {okey('template')}, template) - 1 AS tmpl_idx FROM gt),
gw AS (SELECT r_name AS label, count(*) AS wanted FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name),
gr AS (SELECT gn.*, wanted, unnest(range(least(combinations, wanted)::BIGINT)) AS i FROM gn JOIN gw USING (label)),
gk AS (SELECT * FROM gr QUALIFY row_number() OVER (PARTITION BY label ORDER BY i, combinations, tmpl_idx) <= wanted),
gp AS (SELECT *, (i::HUGEINT * 2147483647 + {u32('label', 'template', "'start'")}) % combinations AS c FROM gk),
gen AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY tmpl_idx, i) - 1 AS sample_idx, tmpl_idx,
    replace(replace(template, coalesce('{{' || s0 || '}}', '@'), coalesce(a.value, '')), coalesce('{{' || s1 || '}}', '@'), coalesce(b.value, '')) AS text
  FROM gp LEFT JOIN gv a ON a.slot = s0 AND a.val_idx = c % n0 LEFT JOIN gv b ON b.slot = s1 AND b.val_idx = c // n0)"""


def _prefix_split(seed: int) -> str:
    return f"""(WITH sc AS (SELECT source AS label, count(*) AS n_c FROM documents GROUP BY source),
rk AS (SELECT doc_id, text, source AS label,
              row_number() OVER (PARTITION BY source ORDER BY {okey('source', 'doc_id', seed=seed)}, doc_id) AS r
       FROM documents)
SELECT doc_id, text, rk.label, CASE WHEN r <= CAST(floor(n_c * 0.8::DOUBLE) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM rk JOIN sc ON rk.label = sc.label)"""


MERGED = f"""
me AS {_prefix_split(SEED)}, mn AS {_prefix_split(7)},
mu AS (SELECT split, text, label, doc_id, 0 AS origin FROM me UNION ALL SELECT split, text, label, doc_id, 1 FROM mn),
mm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split, text, label ORDER BY origin, doc_id) AS rn
                      FROM mu) WHERE rn = 1)"""

LABEL_MAP_PAIRS = "lmp AS (SELECT source, lang, min(doc_id) AS f FROM documents GROUP BY source, lang)"

ORACLES_2 = {
    "generate_samples": f"WITH {_gen_cte()} SELECT label, sample_idx, tmpl_idx, text FROM gen",
    "generate_stats": f"""WITH {_gen_cte()}
SELECT label, count(*) AS n, count(DISTINCT text) AS distinct_texts, min(length(text)) AS min_len,
       max(length(text)) AS max_len FROM gen GROUP BY label""",
    "generate_split": f"""WITH {_gen_cte()},
sc AS (SELECT label, count(*) AS n_c FROM gen GROUP BY label),
rk AS (SELECT label, sample_idx, row_number() OVER (PARTITION BY label
        ORDER BY {okey('label', 'CAST(sample_idx AS VARCHAR)')}, sample_idx) AS r FROM gen)
SELECT rk.label, sample_idx, CASE WHEN r <= CAST(floor(n_c * 0.8::DOUBLE) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM rk JOIN sc ON rk.label = sc.label""",
    "merge_existing_new": f"WITH {MERGED} SELECT split, doc_id, label, origin FROM mm",
    "merged_dataset_counts": f"""WITH {MERGED}
SELECT split, label, CAST(label_idx AS INTEGER) AS label_idx, count(*) AS count
FROM mm JOIN (SELECT source AS label, row_number() OVER (ORDER BY source) - 1 AS label_idx FROM (SELECT DISTINCT source FROM documents)) USING (label)
GROUP BY ALL""",
    "merge_report": f"""WITH {MERGED}
SELECT e.split, e.existing, n.new, m.merged, e.existing + n.new - m.merged AS removed FROM
 (SELECT split, count(*) AS existing FROM me GROUP BY split) e
 JOIN (SELECT split, count(*) AS new FROM mn GROUP BY split) n ON e.split = n.split
 JOIN (SELECT split, count(*) AS merged FROM mm GROUP BY split) m ON e.split = m.split""",
    "label_index_extend": f"""WITH L AS ({LABELLED}),
ex AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx
       FROM (SELECT DISTINCT label FROM L WHERE label LIKE 'Q1%')),
nw AS (SELECT DISTINCT label FROM L WHERE label NOT IN (SELECT label FROM ex))
SELECT label, label_idx FROM ex
UNION ALL SELECT label, CAST((SELECT coalesce(max(label_idx), -1) FROM ex) + row_number() OVER (ORDER BY label) AS INTEGER)
FROM nw""",
    "label_map": f"WITH {LABEL_MAP_PAIRS} SELECT source AS label_id, arg_max(lang, f) AS label_name FROM lmp GROUP BY source",
    "label_map_inverse": f"""WITH {LABEL_MAP_PAIRS},
fwd AS (SELECT source, arg_max(lang, f) AS name, min(f) AS idf FROM lmp GROUP BY source)
SELECT name AS label_name, arg_max(source, idf) AS label_id FROM fwd GROUP BY name""",
    "unknown_labels_lang": f"""SELECT upper({strip('lang')}) AS label, count(*) AS count FROM documents
WHERE upper({strip('lang')}) NOT IN ('DE', 'EN', 'FR') GROUP BY 1""",
    "label_ids_labelled": f"""WITH L AS ({LABELLED}),
ix AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx FROM (SELECT DISTINCT label FROM L))
SELECT doc_id, L.label, label_idx FROM L JOIN ix ON L.label = ix.label""",
}
ORACLES.update(ORACLES_2)


def jq(x: str) -> str:
    """JSON string literal of ``x`` (json.dumps escaping of the named characters)."""
    e = x
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("chr(10)", "\\n"), ("chr(13)", "\\r"), ("chr(9)", "\\t"),
                 ("chr(8)", "\\b"), ("chr(12)", "\\f")):
        src = a if a.startswith("chr(") else q(a)
        e = f"replace({e}, {src}, {q(b)})"
    return f"('\"' || {e} || '\"')"


LABEL_JSON_CTE = f"""
ls AS (SELECT lang AS id, lang AS name,
              'Documents written in ' || lang || ' from ' || CAST(count(DISTINCT source) AS VARCHAR) || ' sources.' AS description
       FROM documents GROUP BY lang),
lj AS (SELECT '{{"labels": [' || string_agg('{{"id": ' || {jq('substr(upper(id), 1, 80)')} || ', "name": ' ||
              {jq('substr(name, 1, 80)')} || ', "description": ' || {jq('substr(description, 1, 180)')} || '}}',
              ', ' ORDER BY id) || ']}}' AS label_json FROM ls)"""

RP = "rp"
TRAIL = "'," + WS + r"*([}\]])'"
PARSE_CTE = f"""
rp0 AS (SELECT doc_id, {C.REPLY_SQL} AS reply FROM documents),
rp1 AS (SELECT doc_id, reply, regexp_replace({strip('reply')}, '(?im)^```(?:json)?{WS}*|{WS}*```$', '', 'g') AS c FROM rp0),
rp2 AS (SELECT *, instr(c, '{{') AS s, CASE WHEN instr(reverse(c), '}}') > 0 THEN length(c) - instr(reverse(c), '}}') + 1 ELSE 0 END AS e FROM rp1),
rp3 AS (SELECT doc_id, reply, CASE WHEN s > 0 AND e > s THEN substr(c, s, e - s + 1) ELSE c END AS cand FROM rp2),
rp4 AS (SELECT doc_id, reply, CASE WHEN json_valid(cand) THEN CAST(cand AS JSON)
              WHEN json_valid(regexp_replace(cand, {TRAIL}, '\\1', 'g'))
              THEN CAST(regexp_replace(cand, {TRAIL}, '\\1', 'g') AS JSON) END AS j FROM rp3),
rp AS (SELECT doc_id,
  CASE WHEN coalesce(length(reply), 0) = 0 THEN 'empty response' WHEN j IS NULL THEN 'invalid json'
       WHEN json_type(j) <> 'OBJECT' THEN 'not a json object' END AS error,
  upper(coalesce(json_extract_string(j, '$.label_id'), '')) AS lid,
  coalesce(json_extract_string(j, '$.label_name'), '') AS lname,
  CASE json_type(j, '$.confidence')
       WHEN 'BOOLEAN' THEN CASE WHEN json_extract_string(j, '$.confidence') = 'true' THEN 1.0 ELSE 0.0 END
       WHEN 'VARCHAR' THEN coalesce(TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE), 0.5)
       WHEN 'DOUBLE' THEN CAST(json_extract_string(j, '$.confidence') AS DOUBLE)
       WHEN 'BIGINT' THEN CAST(json_extract_string(j, '$.confidence') AS DOUBLE)
       WHEN 'UBIGINT' THEN CAST(json_extract_string(j, '$.confidence') AS DOUBLE)
       ELSE 0.5 END AS conf
  FROM rp4)"""


def _pack_consts():
    tmpl = P.SCHEMA_USER_TMPL.replace("{max_labels}", "25")
    budget = 8192 - 1024
    fixed = len(tmpl) - len(P.SAMPLES_SLOT)
    sys_tok = P.py_token_estimate(P.SCHEMA_SYS_PROMPT)
    cap = max(0, ((budget - sys_tok - P.OVERHEAD_TOKENS) * 4 - fixed) // 4 + 1)
    head, tail = tmpl.split(P.SAMPLES_SLOT)
    return budget, fixed, sys_tok, min(400, cap), head, tail


def _pack_sql(src: str, order: str, group: str | None) -> str:
    budget, fixed, sys_tok, k, head, tail = _pack_consts()
    part = f"PARTITION BY {group} " if group else ""
    gsel = f"{group}, " if group else ""
    return f"""WITH pk0 AS ({src}),
pk1 AS (SELECT {gsel}{order} AS o, '- ' || substr(text, 1, 300) AS line,
               row_number() OVER ({part}ORDER BY {order}) AS k FROM pk0),
pk2 AS (SELECT *, sum(length(line)) OVER ({part}ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
        FROM pk1 WHERE k <= {k}),
pk3 AS (SELECT * FROM pk2 WHERE {sys_tok} + greatest(1, ceil(({fixed} + run + k - 1) / 4)) + {P.OVERHEAD_TOKENS} <= {budget})
SELECT {gsel}count(*) AS n_lines, {q(head)} || string_agg(line, chr(10) ORDER BY o) || {q(tail)} AS prompt
FROM pk3 {"GROUP BY " + group if group else ""}"""


def _trim_sql() -> str:
    budget = C.TRIM_CONTEXT - C.TRIM_RESERVE
    limit = budget - P.py_token_estimate(P.SCHEMA_SYS_PROMPT) - P.OVERHEAD_TOKENS
    m = P.SAMPLE_MARKER
    fits = lambda n: f"(greatest(1, ceil(({n}) / 4)) <= {limit})"
    return f"""WITH t0 AS (SELECT doc_id, {q(m)} || chr(10) || text AS u FROM documents),
t1 AS (SELECT doc_id, u, instr(u, {q(m)}) AS pos FROM t0),
t2 AS (SELECT doc_id, u, pos, substr(u, 1, pos - 1 + {len(m)}) || chr(10) AS before,
              substr(u, pos + {len(m)}) AS rest FROM t1),
t3 AS (SELECT *, CASE WHEN length(rest) = 0 THEN []::VARCHAR[]
                      WHEN suffix(rest, chr(10)) THEN string_split(rest, chr(10))[1:-2]
                      ELSE string_split(rest, chr(10)) END AS parts FROM t2),
t4 AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM t3),
t5 AS (SELECT t4.doc_id, line, i, sum(length(line)) OVER (PARTITION BY t4.doc_id ORDER BY i) + i - 1 AS s,
              length(t3.before) AS bl FROM t4 JOIN t3 ON t4.doc_id = t3.doc_id),
t6 AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM t5 WHERE {fits('bl + s')} GROUP BY doc_id),
t7 AS (SELECT t3.doc_id, CASE WHEN {fits('length(u)')} THEN u WHEN pos > 0 THEN before || coalesce(kept, '') ELSE u END AS st
       FROM t3 LEFT JOIN t6 ON t3.doc_id = t6.doc_id)
SELECT doc_id, CASE WHEN {fits('length(st)')} THEN st ELSE substr(st, 1, {max(limit, 0) * 4}) END AS prompt FROM t7"""


ORACLES_3 = {
    "parse_replies": f"""WITH {PARSE_CTE}
SELECT doc_id, CASE WHEN error IS NULL THEN lid ELSE {q(A.FALLBACK_ID)} END AS label_id,
       CASE WHEN error IS NULL THEN lname ELSE {q(A.FALLBACK_NAME)} END AS label_name,
       CASE WHEN error IS NULL THEN conf ELSE 0.0 END AS confidence, error FROM rp""",
    "render_prompts": f"""WITH {LABEL_JSON_CTE}
SELECT doc_id, sha1(text || label_json) AS cache_key,
       {q(P.LABEL_USER_HEAD)} || label_json || {q(P.LABEL_USER_MID)} || text || {q(P.LABEL_USER_TAIL)} AS prompt
FROM documents, lj""",
    "annotate_cached": f"""WITH tr AS (SELECT DISTINCT text FROM {_prefix_split(SEED)} WHERE split = 'train'),
al AS (SELECT DISTINCT text FROM documents),
lb AS (SELECT text, {rule_case(C.LANG_RULES)} AS lab FROM al)
SELECT sha1(text) AS text_sha1, CASE WHEN lab IS NULL THEN {q(A.FALLBACK_ID)} ELSE upper(lab) END AS label_id,
       CASE WHEN lab IS NULL THEN {q(A.FALLBACK_NAME)} ELSE lab END AS label_name,
       CASE WHEN lab IS NULL THEN 0.0 ELSE 0.9 END AS confidence,
       (lab IS NOT NULL AND text IN (SELECT text FROM tr)) AS from_cache FROM lb""",
    "annotation_errors": f"""SELECT sha1(text) AS text_sha1, 'invalid json' AS error FROM (SELECT DISTINCT text FROM documents)
        WHERE {rule_case(C.LANG_RULES)} IS NULL""",
    "annotate_batched": f"""WITH tr AS (SELECT DISTINCT text FROM {_prefix_split(SEED)} WHERE split = 'train'),
lb AS (SELECT DISTINCT text, {rule_case(C.LANG_RULES)} AS lab FROM documents)
SELECT sha1(text) AS text_sha1, CASE WHEN lab IS NULL THEN {q(A.FALLBACK_ID)} ELSE upper(lab) END AS label_id,
       CASE WHEN lab IS NULL THEN {q(A.FALLBACK_NAME)} ELSE lab END AS label_name,
       CASE WHEN lab IS NULL THEN 0.0 ELSE 0.9 END AS confidence, text IN (SELECT text FROM tr) AS from_cache FROM lb""",
    "pack_schema_prompt": _pack_sql(CLEAN_Q, "src_pos", None),
    "pack_prompt_by_lang": _pack_sql("SELECT doc_id, lang, text FROM documents", "doc_id", "lang"),
    "trim_prompts": _trim_sql(),
}
ORACLES.update(ORACLES_3)


SOFTMAX = """
sm0 AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
sm1 AS (SELECT vec_id, x, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM sm0),
sm AS (SELECT vec_id, x, list_transform(e, lambda v: v / list_reduce(e, lambda a, b: a + b)) AS p FROM sm1)"""

ORACLES_4 = {
    "softmax_argmax": f"""WITH {SOFTMAX}
SELECT vec_id, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS pred_idx, round(list_max(p), 4) AS confidence FROM sm""",
    "top2_probs": f"""WITH {SOFTMAX},
tk AS (SELECT vec_id, unnest(list_transform(p, lambda v: round(v, 4))) AS prob, generate_subscripts(p, 1) - 1 AS class_idx FROM sm),
tr AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, class_idx) AS rank FROM tk)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(class_idx AS INTEGER) AS class_idx, prob FROM tr WHERE rank <= 2""",
    "sequence_ids": f"SELECT row_number() OVER (ORDER BY src_pos) AS id, src_pos FROM ({CLEAN_Q})",
    "first_questions": f"SELECT src_pos, text FROM ({CLEAN_Q}) ORDER BY src_pos LIMIT 400",
    "seeded_sample": f"SELECT doc_id FROM documents ORDER BY {okey('doc_id')}, doc_id LIMIT 200",
}
ORACLES.update(ORACLES_4)


ORACLES_5 = {
    "benchmark_leaks": "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON instr(d.text, b.text) > 0 "
                       "WHERE length(b.text) > 0",
    "benchmark_leak_counts": "SELECT b.item_id, count(*) AS n_docs FROM benchmark b JOIN documents d "
                             "ON instr(d.text, b.text) > 0 WHERE length(b.text) > 0 GROUP BY b.item_id",
}
ORACLES.update(ORACLES_5)


ROUND_TRIP = f"SELECT doc_id, label, sha1(text) AS text_sha1, length(text) AS n_chars FROM ({LABELLED})"

ORACLES_6 = {
    "stream_score_questions": "WITH " + rule_scored(
        "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND coalesce(length(text), 0) >= 1",
        "conv_id, turn", R.REFERENCE_RULES, R.REFERENCE_LABELS) + " SELECT conv_id, turn, intent, confidence FROM rs",
    "stream_merge_documents": "SELECT min(doc_id) AS pos, source AS label, sha1(text) AS text_sha1 "
                              "FROM documents GROUP BY text, source",
    "stream_merge_keyed": """SELECT min(doc_id) AS pos, source AS label, sha1(text) AS text_sha1 FROM documents
        WHERE (text, source) NOT IN (SELECT (text, source) FROM documents JOIN labels USING (doc_id)) GROUP BY text, source""",
    "csv_round_trip": ROUND_TRIP,
    "json_round_trip": ROUND_TRIP,
    "training_rows": f"""SELECT doc_id, upper({strip('lang')}) AS label, sha1({strip('text')}) AS text_sha1
FROM documents WHERE text <> '' AND lang IS NOT NULL""",
    "external_scores": """WITH n AS (SELECT doc_id, [1 + (length(t) - length(replace(t, ' und ', ''))) / 5,
1 + (length(t) - length(replace(t, ' the ', ''))) / 5, 1 + (length(t) - length(replace(t, ' el ', ''))) / 4,
1 + (length(t) - length(replace(t, ' le ', ''))) / 4] AS x FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id, ['de', 'en', 'es', 'fr'][list_position(x, list_max(x))] AS intent, round(list_max(x) / list_sum(x), 4) AS confidence FROM n""",
}
ORACLES.update(ORACLES_6)
