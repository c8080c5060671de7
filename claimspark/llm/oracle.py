"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

import math

from . import decontaminate, linededup, mixing, quality

_WORD = r"[^\x20\x09-\x0D]+"

OP9 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP6 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), g AS (SELECT *, sha1(b) AS h, max(page_id) OVER (PARTITION BY sha1(b)) AS top FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN octet_length(b) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(b) >= 1000 AND page_id <> top THEN top END AS refers_to, NULL::VARCHAR AS error FROM g
"""

OP1 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([{", ".join(f"{x}.0::DOUBLE" for x in mixing.WEIGHTS)}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS weight FROM s),
f AS (SELECT *, source_size * {mixing.MOST_COPIES}.0::DOUBLE AS fills, source_size * {mixing.MOST_COPIES}.0::DOUBLE / weight AS at_level FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(fills) OVER (ORDER BY at_level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY at_level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, least(fills, coalesce((SELECT max(level) FROM l WHERE level <= at_level) * weight, fills)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
x AS (SELECT d.*, source_size, target, rate, ('0x' || md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null'))[1:12])::BIGINT / {2**48}.0::DOUBLE AS u FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT source, k, sum(size * (floor(rate)::BIGINT + ((u + k / {mixing.DRAWS}.0::DOUBLE) % 1.0::DOUBLE < rate - floor(rate))::INT)) AS taken, any_value(target) AS target FROM x, range({mixing.DRAWS}) g(k) GROUP BY source, k),
b AS (SELECT source, arg_min(k, (abs(taken - target), k)) AS turn FROM k GROUP BY source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + ((u + turn / {mixing.DRAWS}.0::DOUBLE) % 1.0::DOUBLE < rate - floor(rate))::INT) AS taken
FROM x JOIN b ON x.source IS NOT DISTINCT FROM b.source
"""

_LATIN = "abcdefghijklmnopqrstuvwxyz"
OP12 = rf"""
WITH words AS (SELECT 'd' AS kind, row_number() OVER () AS rn, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'b', row_number() OVER (), item_id, coalesce(text, '') FROM benchmark),
w AS (SELECT kind, rn, id, regexp_extract_all(translate(t, '{_LATIN.upper()}', '{_LATIN}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM words),
b AS (SELECT id, w, least({decontaminate.WINDOW}, len(w)) AS k FROM w WHERE kind = 'b' AND len(w) > 0),
bw AS (SELECT DISTINCT id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
ks AS (SELECT DISTINCT k FROM b),
dw AS (SELECT rn, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT rn, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, ks WHERE kind = 'd' AND len(w) >= k)),
h AS (SELECT rn, dw.k, i, id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
n AS (SELECT rn, count(DISTINCT place) AS n_hit FROM (SELECT rn, unnest(range(i, i + k)) AS place FROM h) GROUP BY rn),
x AS (SELECT rn, count(*) AS n_items, string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) AS items FROM (SELECT DISTINCT rn, id FROM h WHERE id IS NOT NULL) GROUP BY rn)
SELECT w.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (rn) LEFT JOIN x USING (rn) WHERE kind = 'd'
"""

_GAMMA = (1 + quality.ERROR) / (1 - quality.ERROR)
_LOW = -(2**31)
_PRIOR = f"{float(quality.PRIOR_DOCS)!r}::DOUBLE"
_SPREADS = ", ".join(f"('{m}', {x!r}::DOUBLE)" for m, x in quality.SPREAD.items())


def _fences(keys: str) -> str:
    group = f"PARTITION BY {keys}, measure" if keys else "PARTITION BY measure"
    first = f"{keys}, " if keys else ""
    return f"""SELECT {first}measure, max(n_all) AS docs, max(q3 + {quality.REACH!r}::DOUBLE * greatest(q3 - q1, least_spread)) AS fence FROM (
    SELECT {first}measure, max(n_all) AS n_all, arg_min(v, bin) FILTER (upto >= 0.25 * n_all) AS q1, arg_min(v, bin) FILTER (upto >= 0.75 * n_all) AS q3 FROM (
      SELECT {first}measure, bin, v, sum(n) OVER ({group} ORDER BY bin) AS upto, sum(n) OVER ({group}) AS n_all FROM (
        SELECT {first}measure, bin, CASE WHEN bin = {_LOW} THEN 0 ELSE {2 / (_GAMMA + 1)!r}::DOUBLE * pow({_GAMMA!r}::DOUBLE, bin::DOUBLE) END AS v, count(*) AS n FROM b GROUP BY {first}measure, bin))
    GROUP BY {first}measure) JOIN (VALUES {_SPREADS}) x(m, least_spread) ON m = measure GROUP BY {first}measure"""


OP2 = f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS ls FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rp AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rp, range(3) r(k) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN cov USING (doc_id)),
x AS (SELECT *, coalesce(n_symbols / nullif(n_words, 0)::DOUBLE, 0) AS symbol_share, coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) AS dup_line_share,
  coalesce(n_repeat_words / nullif(n_words, 0)::DOUBLE, 0) AS repeat_share, coalesce(word_chars / nullif(n_words, 0)::DOUBLE, 0) AS mean_word FROM m),
u AS (SELECT doc_id, lang, source, unnest([{", ".join(f"'{m}'" for m in quality.SPREAD)}]) AS measure, unnest([{", ".join(quality.SPREAD)}]) AS value FROM x),
b AS (SELECT doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, measure, value, CASE WHEN value <= {quality.LEAST!r} THEN {_LOW} ELSE ceil(ln(value) / {math.log(_GAMMA)!r}::DOUBLE)::INT END AS bin FROM u),
f1 AS ({_fences("lang, source")}), f2 AS ({_fences("lang")}), f3 AS ({_fences("")}),
ok AS (SELECT b.doc_id, bool_and(value <= (f1.docs * f1.fence + {_PRIOR} * ((f2.docs * f2.fence + {_PRIOR} * f3.fence) / (f2.docs + {_PRIOR}))) / (f1.docs + {_PRIOR})) AS within
  FROM b JOIN f1 USING (lang, source, measure) JOIN f2 USING (lang, measure) JOIN f3 USING (measure) GROUP BY b.doc_id),
v AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM x)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND within AS kept FROM v JOIN ok USING (doc_id)
"""

OP3 = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS doc, doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws, regexp_split_to_array(text, '{_WORD}') AS gaps
  FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
l AS (SELECT doc, unnest(ws) AS w, unnest(list_slice(gaps, 1, len(ws))) AS gap, unnest(list_slice(gaps, 2, len(ws) + 1)) AS gap_after, unnest(range(len(ws)))::INT AS i FROM d),
w AS (SELECT doc, i, lower(w) AS low, (sum(length(gap) + length(w)) OVER o)::INT AS e, length(w) AS n, length(gap_after) - length(replace(gap_after, chr(10), '')) > 1 AS breaks, regexp_matches(w, '[.!?…。]["''”’)\]]*$') AS stops FROM l WINDOW o AS (PARTITION BY doc ORDER BY i)),
s AS (SELECT *, e - n AS s, coalesce(sum((stops OR breaks)::INT) OVER o, 0) AS line FROM w WINDOW o AS (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT * REPLACE (stops AND count(*) OVER l >= {linededup.SHORT_UNIT} AS stops), (stops OR breaks) AND count(*) OVER l >= {linededup.SHORT_UNIT} AS closes FROM s WINDOW l AS (PARTITION BY doc, line)),
a AS (SELECT *, coalesce(sum(closes::INT) OVER o, 0) AS whole, coalesce(sum(stops::INT) OVER o, 0) AS sentence FROM b WINDOW o AS (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT *, (7 * unicode(low[1]) + 31 * unicode(low[-1]) + 3 * length(low)) % 97 AS number, count(*) OVER x AS size, i - min(i) OVER x AS nth FROM a WINDOW x AS (PARTITION BY doc, whole)),
c AS (SELECT *, closes OR (size > {linededup.LONG_UNIT} AND nth >= {linededup.AROUND} AND nth < size - {linededup.AROUND}
  AND number < min(number) OVER (PARTITION BY doc, whole ORDER BY i ROWS BETWEEN {linededup.AROUND} PRECEDING AND 1 PRECEDING)
  AND number <= min(number) OVER (PARTITION BY doc, whole ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {linededup.AROUND} FOLLOWING)) AS cuts FROM j),
v0 AS (SELECT *, coalesce(sum(cuts::INT) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM c),
v1 AS (SELECT *, (row_number() OVER (PARTITION BY doc, part ORDER BY i) - 1) // {linededup.MOST_UNIT} AS piece FROM v0),
v AS (SELECT *, greatest({linededup.LONG_UNIT}, count(*) OVER (PARTITION BY doc, part, piece) + {linededup.AROUND}) AS reach FROM v1),
u AS (SELECT doc, min(i) AS pos, min(s) AS s, max(e) AS e, count(*)::INT AS words, list(low ORDER BY i) AS lows FROM v GROUP BY doc, part, piece),
f AS (SELECT lows, min((doc, pos)) AS k FROM u GROUP BY lows HAVING count(*) > 1),
m AS (SELECT doc, pos, s, e, words, k[1] AS k_doc, k[2] - pos AS shift, pos - coalesce(sum(words) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM u JOIN f USING (lows) WHERE (doc, pos) <> k),
r AS (SELECT doc, run, min(pos) AS lo, max(pos + words) AS hi, min(s) AS s, max(e) AS e, count(*) AS units, arg_min(k_doc, pos) AS keep FROM m GROUP BY doc, run),
p AS (SELECT DISTINCT doc, run, lo, hi, k_doc, shift FROM m JOIN r USING (doc, run)),
y AS (SELECT p.*, j, true AS onward, own.e AS place, own.low IS NOT DISTINCT FROM k.low AS same FROM p JOIN v x ON x.doc = p.doc AND x.i = hi, range({linededup.MOST_UNIT + linededup.AROUND}) g(j) JOIN v own ON own.doc = p.doc AND j < x.reach AND own.i = hi + j AND own.sentence = x.sentence LEFT JOIN v k ON k.doc = k_doc AND k.i = hi + shift + j
  UNION ALL SELECT p.*, j, false, own.s, own.low IS NOT DISTINCT FROM k.low FROM p JOIN v x ON x.doc = p.doc AND x.i = lo - 1, range({linededup.MOST_UNIT + linededup.AROUND}) g(j) JOIN v own ON own.doc = p.doc AND j < x.reach AND own.i = lo - 1 - j AND own.sentence = x.sentence LEFT JOIN v k ON k.doc = k_doc AND k.i = lo - 1 + shift - j),
z AS (SELECT * FROM y QUALIFY bool_and(same) OVER (PARTITION BY doc, run, k_doc, shift, onward ORDER BY j)),
g AS (SELECT doc, run, max(j + 1) FILTER (NOT onward) AS l, max(j + 1) FILTER (onward) AS r, min(place) FILTER (NOT onward) AS s, max(place) FILTER (onward) AS e FROM z GROUP BY doc, run),
h AS (SELECT doc, run, lo - coalesce(g.l, 0) AS lo, hi + coalesce(g.r, 0) AS hi, coalesce(g.s, r.s) AS s, coalesce(g.e, r.e) AS e, units, keep FROM r LEFT JOIN g USING (doc, run)),
t AS (SELECT *, coalesce(lo > max(hi) OVER (PARTITION BY doc ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)::INT AS opens FROM h),
q AS (SELECT *, sum(opens) OVER (PARTITION BY doc ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS chain FROM t),
o AS (SELECT doc, min(s)::INT AS "start", max(e)::INT AS "end", sum(units)::BIGINT AS units, (max(hi) - min(lo))::BIGINT AS words, arg_min(keep, lo) AS keep FROM q GROUP BY doc, chain HAVING max(hi) - min(lo) >= {linededup.MIN_WORDS})
SELECT d.doc_id, "start", "end", units, words, k.doc_id AS keep_doc_id FROM o JOIN d USING (doc) JOIN d k ON k.doc = o.keep
"""

ORACLE_SQL = {"op1_mix_sources": OP1, "op2_quality_rules": OP2, "op3_line_dedup": OP3, "op6_warc": OP6, "op9_exact_dedup": OP9, "op12_decontamination": OP12}
