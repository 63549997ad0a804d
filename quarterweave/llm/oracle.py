"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

import math

from .chat import CLOSE, CONTROLS, MIDDLE, OPEN
from .hard_negatives import LEAST_PERCENT, NEGATIVES, POSITIVES, SCALE
from .licenses import PHRASES, TEMPLATES, THRESHOLD, word_set
from .quality import ERROR, FENCES, JUDGED, LIFT, MAX_REPEAT_PERCENT, MIN_WORDS, PRIOR

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13),
keyed AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k FROM win),
first AS (SELECT k, min(doc_id) AS m FROM keyed GROUP BY k),
hit AS (SELECT DISTINCT doc_id, p + j AS q FROM (SELECT keyed.doc_id, p, unnest(range(0, 13)) AS j FROM keyed JOIN first USING (k) WHERE m < keyed.doc_id)),
cut AS (SELECT doc_id, list(q) AS qs FROM hit GROUP BY doc_id),
gone AS (SELECT d.doc_id, len(w) AS n, coalesce(len(qs), 0) AS r FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS t FROM word ANTI JOIN hit USING (doc_id, q) GROUP BY doc_id)
SELECT gone.doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM gone LEFT JOIN kept ON kept.doc_id = gone.doc_id
"""

_GAMMA = math.log((1 + ERROR) / (1 - ERROR))
_MEASURES = {
    "m_word_length": ("word_chars", "n_words"),
    "m_symbols": ("n_symbols", "word_chars"),
    "m_marks": ("(word_chars - n_letters)", "word_chars"),
    "m_dup_lines": ("n_dup_lines", "n_lines"),
    "m_repeats": ("n_repeat_words", "n_words"),
    "m_upper": ("n_upper", "word_chars"),
    "m_loud": ("n_loud", "n_words"),
}
_RATIOS = ", ".join(f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END::DOUBLE AS {m}" for m, (a, b) in _MEASURES.items())
_BUCKETS = " UNION ALL ".join(
    f"SELECT lang, source, '{m}' AS measure, greatest(ceil(ln({m}) / {_GAMMA!r}::DOUBLE) + 100000, 1)::INT AS bucket FROM m WHERE {m} > 0" for m in FENCES
)
_FENCE = "CASE measure " + " ".join(f"WHEN '{m}' THEN {fence!r}::DOUBLE" for m, fence in FENCES.items()) + " END"


def _limit(name: str, keys: str, above: str = "") -> str:
    """Common table expressions for the limits of a level: `name` (keys, measure, centre, spread, lim)."""
    over = f"PARTITION BY {keys}measure"
    at = lambda q: f"(min(CASE WHEN upto >= size * {q}::DOUBLE THEN bucket END) - 100000 - 0.5::DOUBLE) * {_GAMMA!r}::DOUBLE"
    fence = f"exp(centre + {_FENCE} * greatest(spread, {_GAMMA!r}::DOUBLE))"
    blend = lambda c: f"(o.size * o.{c} + {PRIOR} * u.{c}) / (o.size + {PRIOR}) AS {c}"
    shared = " AND ".join(f"o.{k} IS NOT DISTINCT FROM u.{k}" for k in ["measure", *(["lang"] if above == "lng" else [])])
    qualified = "".join(f"o.{k.strip()}, " for k in keys.split(",") if k.strip())
    drawn = f"SELECT {qualified}o.measure AS measure, {blend('centre')}, {blend('spread')}, u.lim AS up FROM {name}_s o JOIN {above} u ON {shared}"
    return f"""{name}_u AS (SELECT {keys}measure, bucket, sum(n) OVER ({over} ORDER BY bucket) AS upto, sum(n) OVER ({over}) AS size
    FROM (SELECT {keys}measure, bucket, count(*) AS n FROM b GROUP BY ALL)),
{name}_s AS (SELECT *, hi - centre AS spread FROM (SELECT {keys}measure, any_value(size) AS size, {at(0.5)} AS centre, {at(0.75)} AS hi FROM {name}_u GROUP BY {keys}measure)),
{name} AS (SELECT {keys}measure, centre, spread, least({fence}, {LIFT}::DOUBLE * up) AS lim FROM ({drawn if above else f"SELECT *, NULL::DOUBLE AS up FROM {name}_s"}))"""


QUALITY_SQL = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] FOR k IN range(1, len(w) - 1)]) AS k FROM t WHERE len(w) >= 3),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p + j) AS n FROM (SELECT doc_id, p, unnest([0, 1, 2]) AS j FROM twice) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT t.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{{L}}\p{{M}}]', '', 'g')) AS n_letters,
    len(list_filter(w, lambda x: ends_with(x, '!'))) AS n_loud
    FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id LEFT JOIN l ON l.doc_id = t.doc_id),
m AS (SELECT *, {_RATIOS} FROM f),
b AS ({_BUCKETS}),
{_limit("every", "")},
{_limit("lng", "lang, ", "every")},
{_limit("own", "lang, source, ", "lng")},
v AS (SELECT m.*, coalesce(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words, false) AS base_failed,
    list_filter([{", ".join(f"CASE WHEN {x} > (SELECT lim FROM own WHERE own.measure = '{by}' AND own.lang IS NOT DISTINCT FROM m.lang AND own.source IS NOT DISTINCT FROM m.source) THEN '{x}' END" for x, by in JUDGED.items())}], lambda x: x IS NOT NULL) AS too_high
    FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {", ".join(_MEASURES)}, base_failed, too_high, (NOT base_failed AND len(too_high) = 0) AS kept FROM v
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_PHRASES = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
_SETS = ", ".join(f"({k}, '{label}', [{', '.join(repr(w) for w in word_set(text))}])" for k, (label, text) in enumerate(TEMPLATES))

LICENSE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_RUN}) AS w, {_LOWER} AS low FROM documents),
ph(phrase, label, n) AS (VALUES {_PHRASES}),
place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
base AS (SELECT doc_id, count(*) AS n_base, min(p) - 1 AS first_word, max(p) - 1 AS last_word, list(DISTINCT label) AS labels
    FROM place JOIN ph ON place.w[p] = split_part(phrase, ' ', 1) WHERE array_to_string(place.w[p:p + n - 1], ' ') = phrase GROUP BY doc_id),
t(k, label, s) AS (VALUES {_SETS}),
line AS (SELECT doc_id, list_distinct(regexp_extract_all(x, {_RUN})) AS s FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS x FROM d)),
hit AS (SELECT doc_id, list(DISTINCT label) AS found, max(len(list_intersect(line.s, t.s)) / len(t.s)) AS score
    FROM line, t WHERE len(list_intersect(line.s, t.s)) >= ceil({THRESHOLD} * len(t.s) - 1e-9) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(found, [])))), ',') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN hit ON hit.doc_id = d.doc_id
"""

AUDIT_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
f AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad,
    (len(w) < 200)::INT AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b, (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT AS c,
    regexp_matches(text, '[#$%&*|]')::INT AS d, (t.doc_id > min(t.doc_id) OVER (PARTITION BY text))::INT AS e FROM t LEFT JOIN labels USING (doc_id)),
n AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY ALL),
x(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.l || q.l || r.l || s.l || u.l AS filter_order FROM x p, x q, x r, x s, x u WHERE len(list_distinct([p.l, q.l, r.l, s.l, u.l])) = 5),
st AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o),
y AS (SELECT part, filter_order, step, n.*, CASE substring(filter_order, step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END = 1 AS fails,
    a + b + c + d + e = 1 AS one, coalesce(list_sum([CASE z WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END FOR z IN string_split(left(filter_order, step - 1), '')]), 0) > 0 AND step > 1 AS earlier FROM n, st),
g AS (SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails AND one), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost FROM y GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, substring(filter_order, step, 1)))::BIGINT AS shapley FROM g
"""

_ESCAPED = rf"regexp_replace(text, '({'|'.join(''.join(chr(92) + x if x in '[]|' else x for x in c) for c in CONTROLS)})', '\\\1', 'g')"

CHAT_SQL = rf"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(role) + length({_ESCAPED}) + {len(OPEN + MIDDLE + CLOSE)})::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples FROM c GROUP BY conv_id
"""

NEGATIVES_SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, a.label AS al, b.vec_id AS b, b.label AS bl, list_inner_product(a.q, b.q)::BIGINT AS s FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b AS p, s AS ps FROM s WHERE al = bl QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= {POSITIVES})
SELECT a AS anchor_id, p AS positive_id, row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b)::INT AS rank, b AS negative_id, ps AS positive_score, s AS negative_score
FROM p JOIN s USING (a) WHERE al <> bl AND {LEAST_PERCENT} * ps <= 100 * s AND s <= ps QUALIFY row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b) <= {NEGATIVES}
"""
