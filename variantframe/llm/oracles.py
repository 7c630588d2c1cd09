"""SQL of the corpus queries for DuckDB, where SQL can express them."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
_BAD = [
    "100 * n_symbols > 10 * n_words",
    "100 * n_symbols > 3 * word_chars",
    "100 * n_capitals > 30 * word_chars",
    "100 * n_bangs > 20 * n_words",
    "100 * n_repeat_words > 40 * n_words",
    "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines",
    "100 * n_words > 40 * word_chars OR 100 * word_chars > 1500 * n_words",
]
_GOOD = [
    "100 * n_symbols <= 2 * n_words AND 100 * n_bangs <= 2 * n_words AND 100 * n_capitals <= 15 * word_chars AND 100 * n_repeat_words <= 25 * n_words",
    "100 * n_repeat_words <= 10 * n_words AND 100 * n_symbols <= 5 * n_words AND 100 * n_bangs <= 5 * n_words",
    "100 * n_capitals > 0.2 * word_chars AND 100 * n_capitals <= 10 * word_chars AND 100 * n_symbols <= 5 * n_words AND 100 * n_repeat_words <= 25 * n_words",
]
_VOTES = ", ".join([f"CASE WHEN {c} THEN -1 ELSE 0 END" for c in _BAD] + [f"CASE WHEN ({c}) AND n_words > 0 THEN 1 ELSE 0 END" for c in _GOOD])
_N = len(_BAD) + len(_GOOD)

OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (length(t) - length(translate(t, '{_CAPITALS}', '')))::BIGINT AS n_capitals, (length(t) - length(translate(t, '!', '')))::BIGINT AS n_bangs,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id),
v AS (SELECT *, [{_VOTES}] AS votes FROM f),
p AS (SELECT votes, count(*)::DOUBLE AS n FROM v GROUP BY votes),
em(step, a) AS (SELECT 0, list_transform(range({_N}), lambda x: 0.85::DOUBLE)
  UNION ALL SELECT step + 1, list(least(0.999::DOUBLE, greatest(0.501::DOUBLE, (s + 8.5) / (c + 10))) ORDER BY k) FROM (
    SELECT step, k, sum(n * CASE votes[k] WHEN 1 THEN q WHEN -1 THEN 1 - q ELSE 0 END) AS s, sum(n * abs(votes[k])) AS c FROM (
      SELECT step, votes, n, 1 / (1 + exp(-list_sum(list_transform(range(1, {_N + 1}), lambda j: votes[j] * ln(a[j] / (1 - a[j])))))) AS q FROM em, p WHERE step < 30), range(1, {_N + 1}) ks(k)
    GROUP BY step, k) GROUP BY step),
m AS (SELECT a FROM em WHERE step = 30),
j AS (SELECT v.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1 / (1 + exp(-list_sum(list_transform(range(1, {_N + 1}), lambda i: votes[i] * ln(a[i] / (1 - a[i])))))) AS q FROM v LEFT JOIN m ON true)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept FROM j
"""


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS lim, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k FROM s),
f AS (SELECT *, (SELECT sum(source_size) FROM o)::BIGINT - coalesce(sum(lim) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
  sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM o),
l AS (SELECT *, min(CASE WHEN (rest / ws) * weight < lim THEN k END) OVER () AS k0 FROM f),
t AS (SELECT l.source, l.source_size, CASE WHEN l.k < l.k0 OR l.k0 IS NULL THEN l.lim::DOUBLE
  ELSE least((SELECT rest / ws FROM l WHERE k = k0) * l.weight, l.lim::DOUBLE) END AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: list_aggregate(ws[i:i + 2], 'string_agg', ' '))
    WHEN len(ws) > 0 THEN [list_aggregate(ws, 'string_agg', ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM sets),
u AS (SELECT doc_id, unnest(s) AS g FROM sets),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(m, n.doc_id)) AS component_id,
  n.doc_id = least(n.doc_id, coalesce(m, n.doc_id)) AS kept
FROM n LEFT JOIN low ON low.a = n.doc_id
"""
