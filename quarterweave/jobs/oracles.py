"""DuckDB SQL for the queries, written apart from the jobs but for the shaped tables and the fixed patterns."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.text import EMAIL, LINE_END, SPACE
from ..sources.shapes import duckdb


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CALL = "symbol, year, quarter"
_STRIP = lambda c: rf"regexp_replace({c}, '\A\s+|\s+\z', '', 'g')"
_WORDS = lambda c: rf"len(regexp_extract_all({c}, '[^{SPACE}]+'))::BIGINT"

_TEXT = rf"""
{duckdb("transcript_items")},
longest AS (SELECT {_CALL}, item_ord, list_sort([{{'n': -length(trim(t)), 'k': k, 't': {_STRIP("t")}}} FOR t, k IN [coalesce(content, ''), coalesce(transcript, ''), coalesce(text, '')]])[1] AS x FROM transcript_items),
raw AS (SELECT {_CALL}, coalesce(string_agg(nullif(x.t, ''), chr(10) || chr(10) ORDER BY item_ord), '') AS raw FROM longest GROUP BY {_CALL}),
clean AS (SELECT *, {_STRIP(r"regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), chr(8203), ''), '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS c FROM raw),
calls AS (SELECT {_CALL}, raw, regexp_replace(replace(translate(c, '’‘“”–—−', '''''""---'), '…', '...'), '(?im)^(\s*Operator)\s*[-–—]\s+', '\1: ', 'g') AS text FROM clean)"""

_AT = lambda p: f"CASE WHEN regexp_matches(text, {_q(p)}) THEN length(regexp_extract(text, {_q('(?ims)' + chr(92) + 'A(.*?)(?:' + p.replace('(?im)', '').replace('(?i)', '') + ')')}, 1)) END"
_DETECT = " UNION ALL ".join(f"SELECT *, {k} AS k, '{m}' AS method, {c}::DOUBLE AS base, {_AT(p)} AS position, regexp_extract(text, {_q(p)}) AS matched FROM turned" for k, (m, c, p) in enumerate(P.DETECTORS))
_CANDIDATES = rf"""{_TEXT},
turned AS (SELECT *, string_split_regex(text, {_q(P.TURN)}) AS gap, regexp_extract_all(text, {_q(P.TURN)}) AS hit FROM calls),
turn AS (SELECT {_CALL}, text, unnest(range(1, len(hit) + 1)) AS i, gap, hit FROM turned),
place AS (SELECT {_CALL}, length(text) AS n, i, (list_sum([length(g) FOR g IN gap[1:i]]) + coalesce(list_sum([length(h) FOR h IN hit[1:i - 1]]), 0))::INT AS spot FROM turn),
late AS (SELECT {_CALL}, min(spot) AS spot FROM place WHERE spot / greatest(n, 1) >= 0.25 GROUP BY {_CALL}),
found AS ({_DETECT}
    UNION ALL SELECT turned.*, 4, '{P.LATE[0]}', {P.LATE[1]}, late.spot, 'Late Operator intervention' FROM turned JOIN late USING ({_CALL})
    UNION ALL SELECT turned.*, 5, '{P.SECOND[0]}', {P.SECOND[1]}, place.spot, 'Second Operator intervention' FROM turned JOIN place USING ({_CALL}) WHERE i = 2),
rated AS (SELECT *, position / greatest(length(text), 1) AS r FROM found WHERE position IS NOT NULL),
cand AS (SELECT {_CALL}, k, method, position::INT AS position, matched, round(r, 6) AS ratio, round(greatest(0, least(1, base
    - CASE WHEN method <> 'explicit_q_and_a_heading' AND r < 0.12 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN method LIKE '%fallback%' THEN 0.05::DOUBLE ELSE 0 END
    - CASE WHEN method LIKE '%fallback%' AND r > 0.92 THEN 0.2::DOUBLE ELSE 0 END + CASE k WHEN 0 THEN 0.02::DOUBLE WHEN 1 THEN 0.01 ELSE 0 END)), 6) AS score FROM rated)"""

_SPLIT = rf"""{_CANDIDATES},
moved AS (SELECT DISTINCT m.symbol, m.year, m.quarter FROM cand m JOIN cand o USING ({_CALL}) WHERE m.k = 1 AND o.k > 1 AND o.position > m.position AND o.position - m.position <= 4000),
choice AS (SELECT cand.*, CASE WHEN moved.symbol IS NOT NULL AND k = 1 THEN greatest(score, 0.97) ELSE score END AS final, row_number() OVER (PARTITION BY {_CALL} ORDER BY (moved.symbol IS NOT NULL AND k = 1) DESC, score DESC, position, k) AS rn
    FROM cand LEFT JOIN moved USING ({_CALL})),
parts AS (SELECT {_CALL}, raw, text, method, position, coalesce(final, 0.0)::DOUBLE AS score, matched,
    {_STRIP("CASE WHEN position IS NULL THEN text ELSE substring(text, 1, position) END")} AS prepared, CASE WHEN position IS NULL THEN '' ELSE {_STRIP("substring(text, position + 1)")} END AS qna
    FROM calls LEFT JOIN (SELECT * FROM choice WHERE rn = 1) USING ({_CALL})),
early AS (SELECT {_CALL}, list(name || ':' || method || ':' || printf('%.1f%%', ratio * 100) ORDER BY k, name) AS w
    FROM (SELECT *, CASE WHEN ratio < 0.12 AND k <> 0 THEN 'qna_candidate_very_early' WHEN ratio > 0.92 AND k > 3 THEN 'qna_fallback_candidate_very_late' END AS name FROM cand) WHERE name IS NOT NULL GROUP BY {_CALL}),
split AS (SELECT parts.*, list_filter(CASE WHEN position IS NULL THEN [CASE WHEN text = '' THEN 'empty_transcript_payload' WHEN regexp_matches(text, {_q(P.MENTION)}) THEN 'qna_mentioned_but_no_reliable_qna_start' END]
    ELSE list_concat(coalesce(w, []), [CASE WHEN qna <> '' AND {_WORDS("qna")} < 250 THEN 'qna_detected_but_too_short' END, CASE WHEN prepared <> '' AND length(prepared) / greatest(length(text), 1) < 0.1 THEN 'prepared_remarks_unusually_short' END,
        CASE WHEN score < 0.7 THEN 'low_confidence_qna_split' END, CASE WHEN method LIKE '%fallback%' THEN 'qna_split_used_fallback_method' END]) END, lambda x: x IS NOT NULL) AS warnings
    FROM parts LEFT JOIN early USING ({_CALL}))"""

_QUALITY = rf"""WITH {_SPLIT},
tail AS (SELECT *, {_STRIP(f"right({_STRIP('raw')}, 300)")} AS tail FROM split),
f AS (SELECT {_CALL}, raw <> '' AS has_text, {_WORDS("raw")} AS words, {_WORDS("prepared")} AS prepared_words, {_WORDS("qna")} AS qna_words, qna <> '' AS qna_found,
    regexp_matches(raw, {_q(P.CLOSING)}) AS closed, regexp_matches(raw, {_q(P.TRUNCATION)}) AS truncated,
    tail <> '' AND (len(list_filter([{", ".join(map(_q, P.UNFINISHED))}], lambda u: ends_with(regexp_replace(lower(tail), '[.!?"''”’)\]}}]+\z', ''), u))) > 0 OR NOT regexp_matches(tail, {_q(P.FINISHED)})) AS mid_sentence,
    regexp_matches(raw, {_q(P.MENTION)}) AS mentioned, len(regexp_extract_all(qna, {_q(P.QUESTION)}))::BIGINT AS question_marks, len(regexp_extract_all(qna, {_q(P.ANSWER)}))::BIGINT AS answer_marks, warnings[1] AS sw FROM tail)
SELECT * EXCLUDE (sw), qna_found AND qna_words >= 250 AND closed AS qna_complete,
    CASE WHEN NOT has_text OR truncated OR mid_sentence OR (words < 2500 AND NOT closed AND NOT qna_found) THEN 'incomplete' WHEN closed THEN 'complete' ELSE 'usable_with_warnings' END AS status,
    array_to_string(list_filter([CASE WHEN NOT has_text THEN 'empty_transcript_payload' END, CASE WHEN has_text AND words < 2500 THEN 'too_short_for_typical_full_earnings_call' END,
        CASE WHEN has_text AND NOT qna_found THEN CASE WHEN mentioned THEN 'qna_mentioned_but_reliable_qna_start_not_detected' ELSE 'qna_start_not_detected' END END, sw,
        CASE WHEN qna_found AND qna_words < 250 THEN 'qna_detected_but_too_short' END, CASE WHEN has_text AND NOT closed THEN 'operator_close_not_detected' END,
        CASE WHEN truncated THEN 'explicit_truncation_marker_detected' END, CASE WHEN mid_sentence THEN 'ends_mid_sentence' END], lambda x: x IS NOT NULL), ',') AS warnings FROM f"""

# Text as the jobs clean it, written as SQL.
_TRIM = lambda c: rf"regexp_replace({c}, '\A[{SPACE}]+|[{SPACE}]+\z', '', 'g')"
_SQUEEZE = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '[{SPACE}]+', ' ', 'g'))"


def _CLEAN(c: str) -> str:
    c = rf"replace(replace(regexp_replace(coalesce({c}, ''), chr(27) || '\[[0-9;]*m', '', 'g'), chr(160), ' '), chr(8203), '')"
    c = rf"regexp_replace(regexp_replace({c}, '([A-Za-z\)])({EMAIL})', '\1 \2', 'g'), '[ \t]+', ' ', 'g')"
    return _TRIM(rf"regexp_replace(regexp_replace({c}, '\n[ \t]+', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


_INT = lambda c: f"try_cast(trim(replace(replace(upper({c}), 'FY', ''), 'Q', '')) AS INT)"
_PERIODS = rf"""{duckdb("transcript_dates")},
periods AS (SELECT symbol, rank::INT AS rank, year, quarter, 'Q' || quarter || ' ' || year AS period_label, call_date FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY year DESC, quarter DESC, call_date DESC, row_ord) AS rank
    FROM (SELECT symbol, {_INT("coalesce(transcript_dates.year, fiscal_year)")} AS year, {_INT("transcript_dates.quarter")} AS quarter, call_date, row_ord FROM transcript_dates) AS p WHERE year >= 1999 AND quarter IS NOT NULL) WHERE rank <= 2),
fy AS (SELECT symbol, (CASE WHEN max(year * 10 + quarter) % 10 = 4 THEN max(year) ELSE max(year) - 1 END)::INT AS fiscal_year FROM periods GROUP BY symbol)"""
_TABLES = rf"""{duckdb("statements")},
tables AS (SELECT * REPLACE (rank::INT AS rank) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, table_name, freq ORDER BY row_ord) AS rank FROM statements) WHERE rank <= CASE freq WHEN 'quarter' THEN 4 ELSE 3 END)"""
_ROW = "concat_ws(':', t.fiscal_year, period, round(amount, 2)::DECIMAL(38, 2)::VARCHAR)"
_MATCH = rf"""found AS (SELECT symbol, count(*) AS n_periods FROM (SELECT DISTINCT symbol, year, quarter FROM periods) GROUP BY symbol),
hits AS (SELECT t.*, EXISTS (SELECT 1 FROM periods p WHERE p.symbol = t.symbol AND p.year = {_INT("t.fiscal_year")} AND upper(t.period) = 'Q' || p.quarter) AS hit FROM tables t WHERE freq = 'quarter'),
quarterly AS (SELECT t.symbol, table_name, count(*) FILTER (hit) AS n_matched, round(sum(amount) FILTER (hit), 2) AS matched_amount, coalesce(string_agg({_ROW}, ';' ORDER BY rank) FILTER (hit), '') AS matched_rows,
    CASE WHEN count(*) FILTER (hit) > 0 THEN '' ELSE coalesce(string_agg({_ROW}, ';' ORDER BY rank) FILTER (rank <= n_periods), '') END AS fallback_rows, count(*) FILTER (hit) = 0 AND count(*) FILTER (rank <= n_periods) > 0 AS fallback_used,
    CASE WHEN count(*) FILTER (hit) > 0 THEN 'exact_period_match' ELSE 'no_exact_period_match' END AS match_status
    FROM hits t LEFT JOIN found USING (symbol) GROUP BY t.symbol, table_name)"""
_ANNUAL = rf"""yearly AS (SELECT t.*, fy.fiscal_year AS fy, coalesce({_INT("t.fiscal_year")} = fy.fiscal_year, false) AS hit FROM tables t JOIN fy ON fy.symbol = t.symbol WHERE freq = 'annual' AND table_name IN ('income_statement', 'balance_sheet', 'cash_flow_statement')),
annual AS (SELECT t.symbol, table_name, fy AS fiscal_year, count(*) FILTER (hit) AS n_matched, round(sum(amount) FILTER (hit), 2) AS matched_amount, coalesce(string_agg({_ROW}, ';' ORDER BY rank) FILTER (hit), '') AS matched_rows,
    CASE WHEN count(*) FILTER (hit) > 0 THEN 'exact_fiscal_year_match' ELSE 'no_exact_fiscal_year_match' END AS match_status FROM yearly t GROUP BY t.symbol, table_name, fy)"""
_ACTIONS = rf"""actions AS (SELECT symbol, unnest(['selected_quarter_prepared_remarks', 'selected_quarter_q_and_a', 'selected_quarter_official_earnings_release']) AS scope, period_label, NULL::INT AS row_limit FROM periods
    UNION ALL SELECT symbol, 'latest_completed_fiscal_year', 'FY' || fiscal_year, 3 FROM fy
    UNION ALL SELECT symbol, 'selected_quarters', string_agg(period_label, ', ' ORDER BY rank), least(greatest(count(*), 1), 4)::INT FROM periods GROUP BY symbol)"""

_W = "(first|second|third|fourth)"
_N = lambda c: f"CASE {c} WHEN 'first' THEN '1' WHEN 'second' THEN '2' WHEN 'third' THEN '3' WHEN 'fourth' THEN '4' END"
_FORM = lambda p, q, y, word: f"CASE WHEN regexp_matches(low, '{p}') THEN 'Q' || " + (_N(f"regexp_extract(low, '{p}', {q})") if word else f"regexp_extract(low, '{p}', {q})") + f" || ' FY' || regexp_extract(low, '{p}', {y}) END"
_HAS = lambda c, xs: "(" + " OR ".join(f"contains({c}, {_q(x)})" for x in xs) + ")"
_FIELDS = rf"""{duckdb("releases")},
r0 AS (SELECT ticker, row_ord, {_CLEAN("coalesce(nullif(title, ''), nullif(headline, ''), nullif(subject, ''), 'Untitled press release')")} AS title,
    coalesce(try_cast(published_date AS date), try_cast(date AS date), try_cast(left(accepted_date, 10) AS date)) AS release_date,
    coalesce(nullif(url, ''), nullif(link, '')) AS url, {_CLEAN("coalesce(nullif(text, ''), nullif(content, ''), '')")} AS text, coalesce(nullif(publisher, ''), nullif(site, '')) AS publisher, symbol FROM releases),
r1 AS (SELECT *, lower(concat_ws(chr(10), title, text, url)) AS low, lower(title) AS head, lower(coalesce(regexp_extract(url, '://([^/]*)', 1), '')) AS host,
    regexp_replace(left(regexp_replace(lower(regexp_replace(title, '[^a-zA-Z0-9]+', '_', 'g')), '^_+|_+$', '', 'g'), 90), '_+$', '') AS slug FROM r0),
r2 AS (SELECT *, replace(host, 'www.', '') AS domain, contains(host, 'sec.gov') AS is_sec,
    coalesce({_FORM(rf"fiscal\s+(?:year\s+)?(\d{{4}})\s+{_W}[-\s]quarter", 2, 1, True)}, {_FORM(rf"{_W}[-\s]quarter\s+(?:(?:of|for)\s+)?(?:fiscal\s+(?:year\s+)?)?(\d{{4}})", 1, 2, True)},
        {_FORM(r"\bq([1-4])\s+fy\s?(\d{4})\b", 1, 2, False)}, {_FORM(r"\bq([1-4])\s+fiscal\s+(\d{4})\b", 1, 2, False)}, {_FORM(r"\bq([1-4])\s+(\d{4})\b", 1, 2, False)}) AS detected_period,
    (CASE WHEN {_HAS("low", P.LIKELY_EARNINGS)} THEN 25 ELSE 0 END + CASE WHEN contains(head, 'results') AND {_HAS("head", ["quarter", "financial"])} THEN 20 ELSE 0 END + CASE WHEN {_HAS("head", ["reports", "announces"])} THEN 10 ELSE 0 END
        - CASE WHEN {_HAS("head", P.LITIGATION)} THEN 100 ELSE 0 END - CASE WHEN contains(head, 'dividend') THEN 50 ELSE 0 END + CASE WHEN upper(symbol) = upper(ticker) THEN 20 ELSE 0 END)::BIGINT AS fixed_score,
    lower(ticker) || '_' || coalesce(strftime(release_date, '%Y%m%d'), 'unknown') || '_' || coalesce(nullif(slug, ''), 'unknown') AS release_id FROM r1)"""
_SCORES = rf"""{_FIELDS}, {duckdb("release_requests")},
scores AS (SELECT ticker, fiscal_year, quarter, row_ord, release_id, release_date, (fixed_score + CASE WHEN contains(low, fiscal_year::VARCHAR) THEN 15 ELSE 0 END + CASE WHEN contains(low, 'q' || quarter) THEN 15 ELSE 0 END
    + CASE WHEN contains(low, ['first', 'second', 'third', 'fourth'][quarter] || ' quarter') THEN 30 ELSE 0 END + CASE WHEN contains(low, 'fiscal ' || fiscal_year) THEN 20 ELSE 0 END
    + CASE WHEN detected_period = 'Q' || quarter || ' FY' || fiscal_year THEN 60 WHEN detected_period IS NOT NULL THEN -100 ELSE 0 END + CASE WHEN abs(year(release_date) - fiscal_year) <= 1 THEN 5 ELSE 0 END)::BIGINT AS score
    FROM r2 JOIN release_requests USING (ticker) WHERE url IS NOT NULL AND NOT is_sec),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker, fiscal_year, quarter ORDER BY score DESC, release_date DESC NULLS LAST, row_ord)::INT AS rank FROM scores)"""

_FORMS = ", ".join(map(_q, P.RELEVANT_FORMS))
_ALL = "concat_ws(' ', form, filing_date, report_date, items, accession, primary_document)"
_ABOUT = _ALL[:-1] + ", primary_doc_description)"

ORACLES: dict[str, str] = {
    "transcript_text": f"WITH {_TEXT} SELECT * FROM calls",
    "qa_candidates": f"WITH {_CANDIDATES} SELECT * EXCLUDE (k) FROM cand",
    "qa_split": f"WITH {_SPLIT} SELECT * EXCLUDE (raw, text) REPLACE (array_to_string(warnings, ',') AS warnings) FROM split",
    "transcript_quality": _QUALITY,
    "transcript_sections": f"WITH {_SPLIT} SELECT {_CALL}, unnest(['full', 'prepared_remarks', 'q_and_a', 'metadata']) AS section, unnest([raw, prepared, qna, '']) AS content FROM split",
    "transcript_chunks": f"WITH {_TEXT}, c AS (SELECT {_CALL}, raw, ceil(length(raw) / 1000)::INT AS total_chunks, unnest(range(1, ceil(length(raw) / 1000)::INT + 1))::INT AS chunk_index FROM calls) SELECT {_CALL}, chunk_index, total_chunks, ((chunk_index - 1) * 1000)::INT AS start_char, least(chunk_index * 1000, length(raw))::INT AS end_char, chunk_index = total_chunks AS is_final, substring(raw, (chunk_index - 1) * 1000 + 1, 1000) AS content FROM c",
    "speaker_positions": f"WITH {_CANDIDATES} SELECT {_CALL}, (i - 1)::INT AS turn, spot AS position FROM place",
    "valid_symbols": f"WITH {duckdb('transcript_dates')} SELECT DISTINCT upper(trim(symbol)) AS symbol, regexp_full_match(upper(trim(symbol)), '[A-Za-z0-9.\\\\-]{{1,12}}') AS valid FROM transcript_dates",
    "latest_periods": f"WITH {_PERIODS} SELECT * FROM periods",
    "latest_fiscal_year": f"WITH {_PERIODS} SELECT * FROM fy",
    "statement_tables": f"WITH {_TABLES} SELECT * FROM tables",
    "period_match": f"WITH {_PERIODS}, {_TABLES}, {_MATCH} SELECT * FROM quarterly",
    "annual_match": f"WITH {_PERIODS}, {_TABLES}, {_ANNUAL} SELECT * FROM annual",
    "followup_actions": f"WITH {_PERIODS}, {_ACTIONS} SELECT * FROM actions",
    "company_profile": f"WITH {_PERIODS}, {duckdb('profiles')} SELECT symbol, name, sector, country FROM (SELECT DISTINCT symbol FROM periods) LEFT JOIN profiles USING (symbol)",
    "evidence_pack": f"""WITH {_PERIODS}, {_TABLES}, {_MATCH}, {_ANNUAL}, {_ACTIONS}, {duckdb("profiles")},
        l AS (SELECT symbol, string_agg(period_label, ',' ORDER BY rank) AS selected_periods, count(*) AS n FROM periods GROUP BY symbol),
        q AS (SELECT symbol, string_agg(table_name || ':' || match_status || ':' || n_matched, ',' ORDER BY table_name) AS financial_tables FROM quarterly GROUP BY symbol),
        a AS (SELECT symbol, string_agg(table_name || ':' || match_status || ':' || n_matched, ',' ORDER BY table_name) AS annual_tables FROM annual GROUP BY symbol),
        x AS (SELECT symbol, count(*) AS n_actions FROM actions GROUP BY symbol)
        SELECT symbol, selected_periods, fiscal_year, financial_tables, annual_tables, coalesce(n_actions, 0)::BIGINT AS n_actions,
            CASE WHEN n IS NULL THEN 'fewer_transcript_periods_found_than_requested,no_selected_periods' WHEN n < 2 THEN 'fewer_transcript_periods_found_than_requested' ELSE '' END AS notes
        FROM (SELECT symbol FROM profiles UNION SELECT symbol FROM periods) LEFT JOIN l USING (symbol) LEFT JOIN fy USING (symbol) LEFT JOIN q USING (symbol) LEFT JOIN a USING (symbol) LEFT JOIN x USING (symbol)""",
    "release_fields": f"WITH {_FIELDS} SELECT ticker, row_ord, title, release_date, url, publisher, domain, is_sec, detected_period, fixed_score, release_id FROM r2",
    "release_scores": f"WITH {_SCORES} SELECT ticker, fiscal_year, quarter, row_ord, score FROM scores",
    "release_candidates": f"WITH {_SCORES} SELECT ticker, fiscal_year, quarter, rank, row_ord, score, release_date FROM ranked WHERE rank <= 20",
    "release_best": f"WITH {_SCORES} SELECT ticker, fiscal_year, quarter, row_ord, score, release_id FROM ranked WHERE rank = 1 AND score >= 55",
    "release_failures": f"WITH {_SCORES} SELECT ticker, fiscal_year, quarter, score AS best_score, CASE WHEN score IS NULL THEN 'no_public_release' ELSE 'below_minimum_score' END AS error FROM release_requests LEFT JOIN (SELECT ticker, fiscal_year, quarter, score FROM ranked WHERE rank = 1) USING (ticker, fiscal_year, quarter) WHERE score IS NULL OR score < 55",
    "filing_search": f"""WITH {duckdb("filings")}, own AS (SELECT *, form IN ({_FORMS}) AS rel, form IN ('8-K', '6-K') AND regexp_matches({_ABOUT}, {_q(P.EARNINGS_LIKE)}) AS earn FROM filings WHERE filing_date BETWEEN '1996-01-01' AND '2000-12-31'),
        c AS (SELECT symbol, greatest(0, count(*) - least(12, count(*) FILTER (rel)))::BIGINT AS omitted FROM own GROUP BY symbol),
        k AS (SELECT *, 'relevant' AS kind FROM own WHERE rel UNION ALL SELECT *, 'earnings' FROM own WHERE earn),
        t AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY row_ord)::INT AS rank FROM k)
        SELECT symbol, accession, form, kind, rank, omitted FROM t JOIN c USING (symbol) WHERE rank <= CASE kind WHEN 'relevant' THEN 12 ELSE 6 END""",
    "filing_rank": f"""WITH {_PERIODS}, {duckdb("filings")}, p AS (SELECT f.*, periods.year AS fiscal_year, periods.quarter, abs(date_diff('day', filing_date::DATE, call_date::DATE)) AS days, {_ABOUT} AS everything FROM filings f JOIN periods USING (symbol) WHERE form IN ({_FORMS})),
        s AS (SELECT *, (CASE WHEN form IN ('8-K', '6-K') THEN 1000 ELSE 250 END + CASE WHEN regexp_matches(items, '(?i)\\b2\\.02\\b|results of operations|financial condition') THEN 350 ELSE 0 END + CASE WHEN regexp_matches(everything, {_q(P.EARNINGS_RELEASE)}) THEN 175 ELSE 0 END
            + CASE WHEN contains(everything, fiscal_year::VARCHAR) THEN 40 ELSE 0 END + CASE WHEN regexp_matches(everything, '(?i)\\bq' || quarter || '\\b|quarter') THEN 30 ELSE 0 END
            + CASE WHEN days <= 2 THEN 350 WHEN days <= 14 THEN 250 WHEN days <= 45 THEN 150 WHEN days <= 90 THEN 50 ELSE 0 END + CASE WHEN contains(report_date, fiscal_year::VARCHAR) THEN 50 ELSE 0 END)::BIGINT AS score FROM p),
        r AS (SELECT *, row_number() OVER (PARTITION BY symbol, fiscal_year, quarter ORDER BY score DESC, filing_date DESC, row_ord) AS rank FROM s)
        SELECT symbol, fiscal_year, quarter, accession, form, filing_date, score FROM r WHERE rank = 1 AND score >= 250""",
    "cik_lookup": f"WITH {duckdb('profiles')}, {duckdb('ticker_map')} , first_of AS (SELECT * FROM ticker_map QUALIFY row_number() OVER (PARTITION BY upper(ticker) ORDER BY row_ord) = 1) SELECT p.symbol, lpad(cik_int::VARCHAR, 10, '0') AS cik, m.title, CASE WHEN cik_int IS NULL THEN 'unknown_symbol' ELSE 'ok' END AS status FROM profiles p LEFT JOIN first_of m ON upper(p.symbol) = upper(m.ticker)",
    "submissions_rows": f"WITH {duckdb('filings')} SELECT symbol, (row_number() OVER w - 1)::INT AS pos, form, filing_date, CASE WHEN row_number() OVER w < count(*) OVER (PARTITION BY symbol) THEN items END AS items FROM filings WINDOW w AS (PARTITION BY symbol ORDER BY row_ord)",
    "filing_documents": f"""WITH {duckdb("filing_documents")}, d AS (SELECT *, concat_ws(' ', name, description, type) AS about FROM filing_documents WHERE regexp_matches(name, '(?i)\\.(htm|html|txt)$')),
        s AS (SELECT *, regexp_matches(about, {_q(P.LEGAL_EXHIBIT)}) AS legal, regexp_matches(about, '(?i)ex[-_ ]?99|exhibit\\s*99') AS ex FROM d),
        t AS (SELECT accession, name, (CASE WHEN ex AND NOT legal THEN 1 WHEN NOT legal THEN 2 ELSE 3 END)::INT AS tier, (CASE WHEN legal THEN -5000 ELSE 0 END + CASE WHEN ex THEN 3000 ELSE 0 END
            + CASE WHEN regexp_matches(about, '(?i)(?:^|[_\\-.])ex[-_]?99[_\\-.]?1(?:\\D|$)|exhibit\\s*99\\.1') THEN 700 WHEN regexp_matches(about, '(?i)(?:^|[_\\-.])ex[-_]?99[_\\-.]?[2-9](?:\\D|$)|exhibit\\s*99\\.[2-9]') THEN -150 ELSE 0 END
            + CASE WHEN name = primary_document THEN 100 ELSE 0 END + CASE WHEN regexp_matches(about, {_q(P.EARNINGS_RELEASE)}) THEN 300 ELSE 0 END + CASE WHEN regexp_matches(lower(name), '\\.html?$') THEN 50 ELSE 0 END)::BIGINT AS score,
            'https://www.sec.gov/Archives/edgar/data/' || cik_int || '/' || replace(accession, '-', '') || '/' || name AS url FROM s)
        SELECT *, row_number() OVER (PARTITION BY accession ORDER BY tier, score DESC, name DESC)::INT AS rank FROM t""",
}

#: What the tables that `table_pages` puts into pages must come to, by page_id % 6, {n} being page_id; pages hold no others.
_PUT = """put AS (SELECT page_id, 1 AS table_no, page_id % 6 AS k FROM pages WHERE contains(html, '</article>'))"""
_KINDS = ["financial", "financial", "non_gaap", "contact", "other", "other"]
_TITLES = ["Consolidated Statements of Operations", "Condensed Consolidated Balance Sheets", "Reconciliation of adjusted EBITDA", "Contacts", "Overview {n}", "Facts"]
_HEADS = ["Item|2025|2024", "Item|March 31, 2025|December 31, 2024", "Item|Value 1", "Item|Value 1", "Item|Value 1", "Item|Value 1"]
_BODIES = [["Assets;;", "Revenue;${n}.5;$9", "Net income;2;1"], ["Cash;5;", "Total;{n}.7;8 {n}.9"], ["EBITDA;{n}.1", "Taxes;2"], ["Media;press@example.com", "Tel;1|2"], ["Revenue;{n}.3"], ["a;b{n}", "A;b"]]
_LABELS = {"financial": "Financial Table", "non_gaap": "Non-GAAP Table", "contact": "Contact Table", "other": "Table"}


def _by_case(values: list) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {_q(v) if isinstance(v, str) else v}" for k, v in enumerate(values)) + " END"


def _markdown(k: int) -> str:
    rows = ["|" + r.replace("|", "\\|").replace(";", "|") + "|" for r in _BODIES[k]]
    return "\n".join([f"|{_HEADS[k]}|", "|-" + "|-:" * _HEADS[k].count("|") + "|", *rows])


ORACLES |= {
    "html_tables": f"WITH {_PUT} SELECT page_id, table_no, ({_by_case([4, 3, 2, 2, 1, 2])})::INT AS row_count, ({_by_case([5, 4, 3, 2, 2, 3])})::INT AS column_count FROM put",
    "table_rows": f"WITH {_PUT}, body(k, row_no, cells) AS (VALUES " + ", ".join(f"({k}, {n}, {_q(r)})" for k, b in enumerate(_BODIES) for n, r in enumerate(b, 1)) + ") SELECT page_id, table_no, row_no, replace(cells, '{n}', page_id::VARCHAR) AS cells FROM put JOIN body USING (k)",
    "table_classes": f"WITH {_PUT} SELECT page_id, table_no, {_by_case(_KINDS)} AS class FROM put",
    "table_titles": f"WITH {_PUT} SELECT page_id, table_no, replace({_by_case(_TITLES)}, '{{n}}', page_id::VARCHAR) AS title FROM put",
    "table_markdown": f"WITH {_PUT} SELECT page_id, table_no, replace({_by_case([f'## {_LABELS[c]} 1: {t}' for c, t in zip(_KINDS, _TITLES, strict=True)])}, '{{n}}', page_id::VARCHAR) AS heading, replace({_by_case([_markdown(k) for k in range(6)])}, '{{n}}', page_id::VARCHAR) AS markdown FROM put",
    "table_counts": f"WITH {_PUT} SELECT p.page_id, count(k) AS total, " + ", ".join(f"count(CASE WHEN {_by_case(_KINDS)} = '{c}' THEN 1 END) AS {c}" for c in _LABELS) + " FROM pages p LEFT JOIN put USING (page_id) GROUP BY p.page_id",
}

_QC = "CASE WHEN upper(trim(quarter)) IN ('1', 'Q1', 'FIRST') THEN 'Q1' WHEN upper(trim(quarter)) IN ('2', 'Q2', 'SECOND') THEN 'Q2' WHEN upper(trim(quarter)) IN ('3', 'Q3', 'THIRD') THEN 'Q3' WHEN upper(trim(quarter)) IN ('4', 'Q4', 'FOURTH') THEN 'Q4' END"
_LINES = lambda c: f"list_transform(string_split_regex(coalesce({c}, ''), '{LINE_END}'), lambda x: {_SQUEEZE('x')})"
_LIKE_TABLE = f"(regexp_matches(line, {_q(P.TABLE_NUMBERS)}) AND (regexp_matches(line, {_q(P.TABLE_SPACING)}) OR regexp_matches(line, {_q(P.TABLE_WORDS)})) AND regexp_matches(line, '[^{SPACE}]'))"
_GONE = f"(x = '' OR lower(x) IN ({', '.join(map(_q, P.BOILERPLATE))}) OR starts_with(lower(x), '{P.BOILERPLATE_STARTS[0]}') OR starts_with(lower(x), '{P.BOILERPLATE_STARTS[1]}'))"
_KEPT = lambda c: _CLEAN(f"array_to_string(list_filter({_LINES(_CLEAN(c))}, lambda x: NOT {_GONE}), chr(10))")


def _islands(name: str, source: str, key: str) -> str:
    """Runs of lines that look like a table or not, of (key, txt) in `source`, as `name` (key, block_no, kind, text)."""
    return f"""{name}_l AS (SELECT {key}, i, line, CASE WHEN {_LIKE_TABLE} THEN 'table_text' ELSE 'text' END AS kind
    FROM (SELECT {key}, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT {key}, string_split_regex(coalesce(txt, ''), '{LINE_END}') AS l FROM {source}))),
{name}_r AS (SELECT *, i - row_number() OVER (PARTITION BY {key}, kind ORDER BY i) AS run FROM {name}_l),
{name}_g AS (SELECT {key}, kind, min(i) AS i, string_agg(line, chr(10) ORDER BY i) AS t FROM {name}_r GROUP BY {key}, kind, run),
{name}_t AS (SELECT {key}, i, kind, CASE kind WHEN 'text' THEN {_CLEAN("t")} ELSE {_TRIM("t")} END AS text FROM {name}_g),
{name} AS (SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY i) - 1)::INT AS block_no, kind, text FROM {name}_t WHERE text <> '')"""


_HAS_ANY = lambda c, words: f"regexp_matches({c}, {_q('|'.join(words))})"
_CONTENT = rf"""{duckdb("release_parts")}, {duckdb("release_pages")},
content AS (SELECT p.*, CASE WHEN k = 3 THEN NULL WHEN length(html) >= 300 THEN 'scraped_public_url_html' WHEN {_CLEAN("p.text")} <> '' THEN 'press_release_text' END AS content_source,
    CASE WHEN k = 3 THEN NULL WHEN length(html) >= 300 THEN html WHEN {_CLEAN("p.text")} <> '' THEN {_CLEAN("p.text")} END AS raw_content FROM release_parts p LEFT JOIN release_pages USING (url))"""
_PAGES = lambda head: rf"""page AS (SELECT *, {_KEPT(head + " || chr(10) || " + _SQUEEZE("body"))} AS top, {_KEPT(head + " || chr(10) || " + _SQUEEZE("body") + " || chr(10) || 'Closing words'")} AS whole FROM content WHERE content_source = 'scraped_public_url_html'),"""
_PARSED = rf"""src AS (SELECT release_id, {_CLEAN("whole")} AS txt FROM page WHERE k = 1 UNION ALL SELECT release_id, raw_content FROM content WHERE content_source = 'press_release_text'),
{_islands("plain", "src", "release_id")},
near AS (SELECT *, list_filter({_LINES("top")}, lambda x: x <> '')[-12:] AS near FROM page WHERE k = 0),
named AS (SELECT *, list_filter(near, lambda x: {_HAS_ANY("lower(x)", P.RELEASE_STATEMENTS + P.RELEASE_NON_GAAP + P.CONTACTS)}) AS named FROM near),
titled AS (SELECT *, left(coalesce(named[-1], near[-1], 'Table 1'), 180) AS title, lower(' 2025 2024 ' || label || ' ' || n || ' ' || n1) AS cells FROM named),
classed AS (SELECT *, CASE WHEN {_HAS_ANY("lower(title) || ' ' || cells", P.RELEASE_NON_GAAP)} THEN 'non_gaap' WHEN {_HAS_ANY("lower(title)", P.RELEASE_STATEMENTS)} OR s >= 3 THEN 'financial' WHEN {_HAS_ANY("lower(title) || ' ' || cells", P.CONTACTS)} OR regexp_matches(cells, '{EMAIL}') THEN 'contact'
    WHEN s >= 1 AND NOT {_HAS_ANY("lower(title) || ' ' || cells", P.ADJUSTED)} THEN 'financial' ELSE 'other' END AS class FROM (SELECT *, len(list_filter([{", ".join(map(_q, P.ROW_SIGNALS))}], lambda x: contains(cells, x))) AS s FROM titled)),
made AS (SELECT release_id, 0 AS o, 'text' AS kind, top AS text, NULL AS title, NULL AS class, NULL AS markdown FROM page WHERE k = 0 AND top <> ''
    UNION ALL SELECT release_id, 1, 'table', NULL, title, class, CASE class WHEN 'contact' THEN '|Item|Value 1|Value 2|' || chr(10) || '|-|-:|-:|' || chr(10) || '|2025|2024||' ELSE '|Item|2025|2024|' || chr(10) || '|-|-:|-:|' END || chr(10) || '|' || label || '|' || n || '|' || n1 || '|' FROM classed
    UNION ALL SELECT release_id, 2, 'text', 'Closing words', NULL, NULL, NULL FROM page WHERE k = 0
    UNION ALL SELECT release_id, block_no, kind, text, CASE kind WHEN 'table_text' THEN 'Text-formatted table' END, CASE kind WHEN 'table_text' THEN 'other' END, NULL FROM plain),
sections AS (SELECT release_id, (row_number() OVER (PARTITION BY release_id ORDER BY o) - 1)::INT AS section_no, kind, text, title, class, markdown
    FROM (SELECT *, row_number() OVER (PARTITION BY release_id, kind, {_SQUEEZE("lower(text)")} ORDER BY o) AS again FROM made) WHERE kind <> 'text' OR again = 1)"""
_SECTIONS = f"{_CONTENT}, {_PAGES('head')} {_PARSED}"
_STORY = rf"""story AS (SELECT release_id, {_CLEAN("string_agg(text, chr(10) || chr(10) ORDER BY section_no)")} AS story FROM sections WHERE kind = 'text' GROUP BY release_id),
heads AS (SELECT release_id, own, list_filter(own[:80], lambda x: (contains(lower(x), 'reports') OR contains(lower(x), 'announces')) AND (contains(lower(x), 'results') OR contains(lower(x), 'earnings')) OR contains(lower(x), 'financial results') AND length(x) < 220) AS hit
    FROM (SELECT release_id, list_filter({_LINES("story")}, lambda x: x <> '') AS own FROM story)),
counts AS (SELECT c.release_id, {", ".join(f"count(*) FILTER (s.kind = 'table' AND class = '{x}') AS {x}" for x in ("financial", "non_gaap", "contact", "other"))}, count(*) FILTER (s.kind = 'table_text') AS text_tables, count(*) FILTER (s.kind <> 'text') AS total FROM content c LEFT JOIN sections s USING (release_id) GROUP BY c.release_id),
numbered AS (SELECT *, sum((kind <> 'text')::INT) OVER (PARTITION BY release_id ORDER BY section_no) AS no, {_CLEAN("title")} AS t FROM sections),
body AS (SELECT release_id, string_agg(CASE kind WHEN 'text' THEN {_CLEAN("text")} WHEN 'table' THEN '## ' || CASE class WHEN 'financial' THEN 'Financial Table' WHEN 'non_gaap' THEN 'Non-GAAP Table' WHEN 'contact' THEN 'Contact Table' ELSE 'Table' END || ' ' || no
    || CASE WHEN t <> '' AND NOT regexp_matches(t, '(?i)^table\s+\d+$') THEN ': ' || t ELSE '' END || chr(10) || chr(10) || {_CLEAN("markdown")} ELSE '## Table ' || no || ': ' || t || chr(10) || chr(10) || '```text' || chr(10) || {_TRIM("text")} || chr(10) || '```' END, chr(10) || chr(10) ORDER BY section_no) AS parts FROM numbered GROUP BY release_id),
top AS (SELECT c.*, coalesce(hit[1], own[1], head) AS headline, counts.* EXCLUDE (release_id), coalesce(parts, '') AS parts FROM content c LEFT JOIN heads USING (release_id) LEFT JOIN body USING (release_id) LEFT JOIN counts USING (release_id))"""


def _written(header: list[str]) -> str:
    """A release's Markdown from `top` and the lines of its header, of which null ones are left out."""
    return _TRIM(f"concat('---', chr(10), concat_ws(chr(10), {', '.join(header)}), chr(10), '---', chr(10), chr(10), '# ', headline, chr(10), chr(10), parts)") + " || chr(10)"


def _line(name: str, value: str) -> str:
    return f"""CASE WHEN coalesce({value}, '') <> '' THEN '{name}: "' || replace({_SQUEEZE(value)}, '"', '\\"') || '"' END"""


_TABLES_LINES = [f"'tables_{k}: ' || {c}" for k, c in (("financial", "financial"), ("non_gaap", "non_gaap"), ("contact", "contact"), ("other", "other"), ("text", "text_tables"))]
_FEED_SOURCE = _line("source", "'Press release feed + public page'")
_MARKDOWN = f"""{_SECTIONS}, {_STORY},
md AS (SELECT *, CASE WHEN content_source IS NOT NULL THEN {_written([_line("id", "release_id"), _line("ticker", "ticker"), _FEED_SOURCE, _line("period_requested", "period"), _line("headline", "headline"), _line("title", "head"), _line("url", "url"), *_TABLES_LINES])} END AS markdown FROM top)"""
#: Chosen releases in the place of `content`, with a key for each and what its page is made of.
_DOCUMENTS = f"""{_SCORES}, {duckdb("release_parts")}, won AS (SELECT ticker || ':' || row_ord AS release_id, fiscal_year, quarter, score FROM ranked WHERE rank = 1 AND score >= 55),
content AS (SELECT r2.ticker || ':' || r2.row_ord AS release_id, r2.ticker, r2.release_id AS own_id, r2.url, title AS head, p.head AS page_head, p.k, p.label, p.n, p.n1, p.body, publisher, domain, release_date::VARCHAR AS release_date, detected_period,
    CASE WHEN k < 2 THEN 'scraped_public_url_html' WHEN {_CLEAN("r2.text")} <> '' THEN 'press_release_text' END AS content_source, CASE WHEN k >= 2 THEN {_CLEAN("r2.text")} END AS raw_content
    FROM r2 JOIN release_parts p ON p.doc_id = row_ord AND p.ticker = r2.ticker WHERE r2.ticker || ':' || row_ord IN (SELECT release_id FROM won)), {_PAGES("page_head")} {_PARSED}, {_STORY},
asked AS (SELECT t.*, w.fiscal_year, w.quarter, w.score, 'Q' || w.quarter || ' FY' || w.fiscal_year AS period FROM top t JOIN won w USING (release_id)),
md AS (SELECT *, CASE WHEN content_source IS NOT NULL THEN {_written([_line("id", "own_id"), _line("ticker", "ticker"), _FEED_SOURCE, _line("publisher", "publisher"), _line("site", "domain"), _line("release_date", "release_date"), _line("period_requested", "period"), _line("period_detected", "detected_period"), _line("headline", "headline"), _line("title", "head"), _line("url", "url"), *_TABLES_LINES])} END AS markdown FROM asked)"""
_POSITIVE = _q(P.POSITIVE_TERMS)

ORACLES |= {
    "period_labels": f"WITH {duckdb('transcript_dates')}, l AS (SELECT symbol, coalesce(year, fiscal_year) AS year, quarter, {_QC} AS quarter_code FROM transcript_dates) SELECT *, CASE quarter_code WHEN 'Q1' THEN 'first' WHEN 'Q2' THEN 'second' WHEN 'Q3' THEN 'third' WHEN 'Q4' THEN 'fourth' END AS quarter_word, CASE WHEN quarter_code IS NULL THEN '' ELSE concat_ws(' ', quarter_code, year) END AS call_label, quarter_code || ' FY' || year AS release_label FROM l",
    "recheck_actions": f"SELECT symbol, year, quarter, 'recheck_transcript_dates' AS scope, greatest(2000, year - 1)::INT AS min_year FROM ({_QUALITY}) WHERE status = 'incomplete'",
    "widen_actions": f"WITH {_PERIODS}, {duckdb('profiles')} SELECT DISTINCT symbol, 'widen_min_year' AS scope, 1998::INT AS min_year FROM profiles ANTI JOIN periods USING (symbol)",
    "evidence_manifest": f"WITH {_PERIODS}, {_TABLES}, {_MATCH}, {_ANNUAL} SELECT symbol, freq, table_name, fiscal_year, period, amount FROM hits WHERE hit UNION ALL SELECT symbol, freq, table_name, fiscal_year, period, amount FROM yearly WHERE hit",
    "release_content": f"WITH {_CONTENT} SELECT release_id, content_source, CASE WHEN k = 3 THEN 'regulator_url_refused' WHEN content_source IS NULL THEN 'no_usable_content' END AS content_error, CASE WHEN raw_content IS NOT NULL THEN CASE WHEN regexp_matches(lower(raw_content), '<html|<body|<table|</table|<p') THEN 'html' ELSE 'txt' END END AS raw_format, length(raw_content)::INT AS n_chars, sha256(raw_content) AS raw_sha256 FROM content",
    "release_sections": f"WITH {_SECTIONS} SELECT * FROM sections",
    "release_markdown": f"WITH {_MARKDOWN} SELECT release_id, headline, CASE WHEN content_source IS NOT NULL THEN financial END AS financial, CASE WHEN content_source IS NOT NULL THEN total END AS total, markdown FROM md",
    "release_manifest": f"WITH {_MARKDOWN} SELECT release_id AS id, period, headline, 'markdown/' || release_id AS llm_markdown_path, 'raw/raw_format=' || CASE WHEN regexp_matches(lower(raw_content), '<html|<body|<table|</table|<p') THEN 'html' ELSE 'txt' END || '/' || release_id AS raw_path, financial, non_gaap, contact, other, text_tables, total, length(markdown)::BIGINT AS characters, {_WORDS('markdown')} AS words, greatest(1, length(markdown) // 4)::BIGINT AS rough_tokens_estimate, '2026-01-01T00:00:00+00:00' AS created_at_utc FROM md WHERE content_source IS NOT NULL",
    "release_documents": f"WITH {_DOCUMENTS} SELECT ticker, fiscal_year, quarter, own_id AS release_id, score, content_source, headline, CASE WHEN content_source IS NOT NULL THEN total END AS n_tables, markdown FROM md",
    "paragraphs": rf"""WITH g AS (SELECT doc_id, list_filter(list_transform(string_split_regex(array_to_string({_LINES("text")}, chr(10)), '
{{2,}}'), lambda g: {_CLEAN("replace(" + _TRIM("g") + ", chr(10), ' ')")}), lambda g: g <> '') AS p FROM documents)
        SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS paragraph_no, unnest(p) AS paragraph FROM g""",
    "text_table_blocks": f"WITH src AS (SELECT doc_id, text AS txt FROM documents), {_islands('blocks', 'src', 'doc_id')} SELECT * FROM blocks",
}


def _exhibits(documents: str, contents: str, requests: str) -> str:
    """The best exhibit of each filing and request as `best`, from ranked `documents` and tables by name."""
    return rf"""docs AS ({documents}),
        low AS (SELECT *, min(tier) OVER (PARTITION BY accession) AS lowest FROM docs),
        r AS (SELECT low.accession, low.name, url, score AS metadata_score, coalesce(text, '') AS text, coalesce(n_tables, 0) AS n_tables, fiscal_year, quarter, lower(left(coalesce(text, ''), 40000)) AS low, len(regexp_extract_all(coalesce(text, ''), {_POSITIVE})) AS positive, ['first', 'second', 'third', 'fourth'][quarter] AS w
            FROM low LEFT JOIN {contents} c ON c.accession = low.accession AND c.name = low.name LEFT JOIN {requests} q ON q.accession = low.accession WHERE tier = lowest AND rank <= 12),
        s AS (SELECT *, (CASE WHEN regexp_matches(left(text, 20000), {_q(P.LEGAL_EXHIBIT)}) THEN -5000 ELSE 0 END + least(positive, 12) * 180 + CASE WHEN n_tables >= 3 THEN 500 ELSE n_tables * 50 END + CASE WHEN length(text) >= 10000 THEN 200 WHEN length(text) >= 5000 THEN 80 ELSE 0 END
            - CASE WHEN regexp_matches(left(text, 20000), {_q(P.CAPITAL_RETURN)}) AND positive < 3 AND n_tables < 3 THEN 1200 ELSE 0 END
            + CASE WHEN quarter IS NULL THEN 0 ELSE CASE WHEN regexp_matches(low, w || '\s+quarter\s+(?:fiscal\s+)?' || fiscal_year || '|fiscal\s+' || fiscal_year || '\s+' || w || '\s+quarter|q' || quarter || '\s+(?:fy|fiscal\s+)?' || fiscal_year) THEN 2500 ELSE 0 END + CASE WHEN contains(low, fiscal_year::VARCHAR) THEN 200 ELSE 0 END
                + CASE WHEN contains(low, w || ' quarter') THEN 500 ELSE 0 END + CASE WHEN contains(low, 'q' || quarter) THEN 250 ELSE 0 END - CASE WHEN contains(low, w || ' quarter') THEN 0 ELSE 600 * len(list_filter(['first', 'second', 'third', 'fourth'], lambda x: x <> w AND contains(low, x || ' quarter'))) END END)::BIGINT AS content_score FROM r),
        best AS (SELECT accession, fiscal_year, quarter, count(*) OVER (PARTITION BY accession, fiscal_year, quarter) AS n_read, name, url, metadata_score, content_score, metadata_score + content_score AS score, length(text)::INT AS n_chars, n_tables
            FROM s QUALIFY row_number() OVER (PARTITION BY accession, fiscal_year, quarter ORDER BY metadata_score + content_score DESC, length(text) DESC, name DESC) = 1)"""


#: What the pages of exhibits read: heading, text, a line pair for each table, an item, closing words twice.
_READ = rf"""{duckdb("exhibit_contents")}, pages_read AS (SELECT accession, name, n_tables, {_TRIM("text")} AS own, 'Exhibit ' || name || chr(10) || chr(10) || {_TRIM("text")} || repeat(chr(10) || chr(10) || 'Revenue20252024' || chr(10) || chr(10) || 'Sales$54', n_tables)
    || CASE n_tables WHEN 0 THEN chr(10) ELSE chr(10) || chr(10) END || 'one item' || chr(10) || chr(10) || 'Closing words' || chr(10) || chr(10) || 'Closing words' AS text
    FROM (SELECT accession, name, min(text) AS text, min(n_tables) AS n_tables FROM exhibit_contents GROUP BY ALL))"""
_ONE_BEST = "SELECT * EXCLUDE (fiscal_year, quarter, n_tables) FROM best"
_TABLE = "'## ' || label || ' ' || i || named || chr(10) || chr(10) || '|Item|2025|2024|' || chr(10) || '|-|-:|-:|' || chr(10) || '|Revenue|2025|2024|' || chr(10) || '|Sales|$5|4|'"
_FILINGS = rf"""{_READ}, chosen AS ({ORACLES["filing_rank"]}), {_exhibits("SELECT f.* FROM (" + ORACLES["filing_documents"] + ") f WHERE accession IN (SELECT accession FROM chosen)", "pages_read", "(SELECT DISTINCT accession, fiscal_year, quarter FROM chosen)")},
    j AS (SELECT c.symbol, c.fiscal_year, c.quarter, c.accession, c.filing_date, b.name, b.url, b.n_read, b.score, own, pr.n_tables, CASE WHEN own IS NULL THEN 'Earnings Release of a Filing' ELSE 'Exhibit ' || b.name END AS headline, CASE WHEN length(own) <= 220 THEN own ELSE 'Exhibit ' || b.name END AS title
        FROM chosen c JOIN best b USING (accession, fiscal_year, quarter) LEFT JOIN pages_read pr ON pr.accession = c.accession AND pr.name = b.name),
    k AS (SELECT *, CASE WHEN {_HAS_ANY("lower(title || ' revenue 2025 2024 sales $ 5 4')", P.NON_GAAP)} THEN 'Non-GAAP Table' WHEN {_HAS_ANY("lower(title)", P.STATEMENTS)} THEN 'Financial Table' WHEN {_HAS_ANY("lower(title)", P.CONTACTS)} THEN 'Contact Table' ELSE 'Table' END AS label, ': ' || left(title, 180) AS named FROM j)
    SELECT symbol, fiscal_year, quarter, accession, filing_date, name, url, n_read, score, headline, coalesce(n_tables, 0)::BIGINT AS n_tables, concat('---', chr(10), concat_ws(chr(10), {_line("symbol", "symbol")}, {_line("fiscal_year", "fiscal_year::VARCHAR")}, {_line("fiscal_quarter", "quarter::VARCHAR")}, {_line("requested_period", "'Q' || quarter || ' FY' || fiscal_year")},
        {_line("filing_date", "filing_date")}, {_line("accession_number", "accession")}, {_line("selected_document", "name")}, {_line("selected_document_url", "url")}, 'table_count: "' || CASE WHEN n_tables > 0 THEN n_tables::VARCHAR ELSE '' END || '"'), chr(10), '---', chr(10), chr(10), '# ', headline,
        CASE WHEN own IS NOT NULL THEN concat(chr(10), chr(10), concat_ws(chr(10) || chr(10), own, nullif(array_to_string([{_TABLE} FOR i IN range(1, n_tables + 1)], chr(10) || chr(10)), ''))
            , chr(10), chr(10), '- one item', chr(10), 'Closing words') ELSE '' END, chr(10)) AS markdown FROM k"""

ORACLES |= {
    "exhibit_rank": f"WITH {duckdb('exhibit_contents')}, {duckdb('exhibit_requests')}, {_exhibits(ORACLES['filing_documents'], 'exhibit_contents', 'exhibit_requests')} {_ONE_BEST}",
    "exhibit_pages": f"WITH {_READ}, {duckdb('exhibit_requests')}, {_exhibits(ORACLES['filing_documents'], 'pages_read', 'exhibit_requests')} {_ONE_BEST}",
    "filing_releases": f"WITH {_FILINGS}",
    # The same results from landed payloads.
    "payload_evidence": f"SELECT e.*, matched_total FROM ({ORACLES['evidence_pack']}) e LEFT JOIN (WITH {_PERIODS}, {_TABLES}, {_MATCH} SELECT symbol, round(sum(amount), 2) AS matched_total FROM hits WHERE hit GROUP BY symbol) t USING (symbol)",
    "payload_filing_rank": ORACLES["filing_rank"],
    "payload_release_documents": ORACLES["release_documents"],
}
