"""DuckDB SQL for the text queries that SQL can express: plain forms over all pairs, for small tables."""

from weftline.llm.chat_format import CONTROLS, END, ESCAPE, TURN
from weftline.llm.common import LOWER, UPPER
from weftline.llm.hard_negatives import BUCKETS, EVERY, HIGH, LOW, MOVED, NEGATIVES, POSITIVES, SCALE
from weftline.llm.ngram_join import PERCENT, WORDS
from weftline.llm.quality_rules import BULLETS, ELLIPSES, MARKS, MEASURES, RULES, SPACE, STOP_WORDS, SYMBOLS, Rule

_LINKED = "reach(id, low) AS (SELECT a, a FROM links UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.id WHERE r.low < l.b), least AS (SELECT id, min(low) AS component FROM reach GROUP BY id)"

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct([array_to_string(ws[i : i + {WORDS - 1}], ' ') FOR i IN range(1, greatest(2, len(ws) - {WORDS - 2}))]) END AS g FROM w),
t AS (SELECT doc_id, md5(unnest(g)) AS token FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM t x JOIN t y ON x.token = y.token AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM p JOIN s x ON p.a = x.doc_id JOIN s y ON p.b = y.doc_id WHERE 100 * both_n >= {PERCENT} * (len(x.g) + len(y.g) - both_n)),
{_LINKED}
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id FROM s LEFT JOIN least ON id = doc_id"""

DECONTAMINATE = f"""
WITH lower_d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
lower_b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item_id, least(13, len(ws)) AS n, array_to_string(ws[i : i + 12], ' ') AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 11))) AS i FROM lower_b WHERE len(ws) > 0) x),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM lower_d CROSS JOIN sizes WHERE len(ws) >= n) x),
found AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) x GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) x GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM lower_d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _escaped(column: str) -> str:
    """The escapes of a text, as nested replacements."""
    out = f"replace({column}, '{ESCAPE}', '{ESCAPE * 2}')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}{ESCAPE}.{c[1:]}')"
    return out


_FRAME = len(TURN) + 1 + len(END) + 1
CHAT_FORMAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
 CAST(sum({_FRAME} + length({_escaped('text')}) + length(replace({_escaped('role')}, chr(10), '{ESCAPE}n'))) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM g"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) >= 0.95 * sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))),
{_LINKED}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN least ON id = vec_id"""



def _holds(rule: Rule) -> str:
    """A quality rule as a condition."""
    top, bottom = (rule.top, "1") if rule.bottom is None else (f"1000 * {rule.top}", rule.bottom)
    return " AND ".join([f"{top} >= {rule.least} * {bottom}"] * (rule.least is not None) + [f"{top} <= {rule.most} * {bottom}"] * (rule.most is not None))


def _listed(words: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^{SPACE}]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls FROM d),
win AS (SELECT k, i, array_to_string(ws[i : i + 2], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2) x),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) x WHERE c > 1) y GROUP BY k),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[{SPACE}]+', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[{SYMBOLS}]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
 len(list_filter(ws, lambda x: list_contains({_listed(STOP_WORDS)}, rtrim(lower(x), '{MARKS}')))) AS n_stop_words, len(ls) AS n_lines,
 len(list_filter(ls, lambda x: list_bool_or([starts_with(ltrim(x, ' '), b) FOR b IN {_listed(BULLETS)}]))) AS n_bullet_lines, len(list_filter(ls, lambda x: list_bool_or([suffix(rtrim(x, ' '), b) FOR b IN {_listed(ELLIPSES)}]))) AS n_ellipsis_lines
 FROM w LEFT JOIN rep USING (k))
SELECT doc_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in MEASURES)}, NOT ({" AND ".join(_holds(r) for r in RULES if r.base)}) AS base_failed, {" AND ".join(map(_holds, RULES))} AS kept,
 array_to_string(list_filter([{", ".join(f"CASE WHEN NOT ({_holds(r)}) THEN '{r.name}' END" for r in RULES)}], lambda x: x IS NOT NULL), ',') AS broken FROM m"""

HARD_NEGATIVES = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % {BUCKETS} ELSE label END AS label, [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""

ORACLE_SQL = {
    "op1_ngram_join": NGRAM_JOIN,
    "op5_decontaminate": DECONTAMINATE,
    "op6_chat_format": CHAT_FORMAT,
    "op7_embedding_dedup": EMBEDDING_DEDUP,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op13_quality_rules": QUALITY_RULES,
}
