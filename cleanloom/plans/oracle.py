"""SQL for DuckDB that gives the rows of cleanloom.plans.queries."""

from __future__ import annotations

from collections.abc import Sequence

from .. import vocabulary as V
from . import queries as Q


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: Sequence[str]) -> str:
    return f"[{', '.join(map(_text, values))}]"


def _picked(key: str, values: Sequence[str]) -> str:
    return f"({_list(values)})[CAST({key} % {len(values)} AS INTEGER) + 1]"


def _in(values: Sequence[str]) -> str:
    return f"({', '.join(map(_text, values))})"


_WS = r"\s+"
_STRIP = r"^\s+|\s+$"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '{_STRIP}', '', 'g')"


def _squeeze(x: str) -> str:
    return _strip(f"regexp_replace({x}, '{_WS}', ' ', 'g')")


_DIGITS = lambda x: f"translate({x}, '{V.ARABIC_DIGITS}', '{V.WESTERN_DIGITS}')"
_WORDY = r"\p{L}\p{M}\p{N}_"
_PLACEHOLDER = rf"(?i)^[^\p{{L}}\p{{M}}\p{{N}}]*(?:{'|'.join(V.PLACEHOLDER_TERMS)})[^\p{{L}}\p{{M}}\p{{N}}]*$"
_AR, _EN = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]", "[A-Za-z]"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _language(x: str) -> str:
    return f"CASE WHEN {_has(x, _AR)} AND {_has(x, _EN)} THEN 'mixed' WHEN {_has(x, _AR)} THEN 'ar' WHEN {_has(x, _EN)} THEN 'en' ELSE 'other' END"


_ARABIC_PLAIN = _strip(r"regexp_replace(translate(v, 'أإآةى', 'اااهي'), '[\x{064B}-\x{065F}]', '', 'g')")
_MARKS = "ـ‌‍‎‏﻿"


def _arabic(x: str) -> str:
    return f"translate(regexp_replace({x}, '[\\x{{064B}}-\\x{{0652}}\\x{{0670}}]', '', 'g'), 'أإآٱةى{_MARKS}', 'ااااهي')"


def _title(x: str) -> str:
    """Capitalises after blanks."""
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def _english(x: str) -> str:
    return _title(_squeeze(f"trim({x}, '.,;:!?\"''()[]{{}}')"))


def _missing(x: str, terms: Sequence[str]) -> str:
    return f"({x} IS NULL OR lower({_strip(x)}) IN {_in(terms)})"


_ENGLISH_SANITISED = lambda x: f"lower({_strip(f'''regexp_replace({x}, '[^{chr(92)}p{{L}}{chr(92)}p{{M}}{chr(92)}p{{N}}]+', ' ', 'g')''')})"
_MATCHING = lambda x: _squeeze(f"regexp_replace(lower({x}), '[^{_WORDY}\\s]', '', 'g')")
_KEYWORDS = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[{_WORDY}]+'), lambda w: length(w) >= 2)"


def _first_seen(values: str) -> str:
    return f"list_filter({values}, lambda w, i: list_position({values}, w) = i)"


def _contractions(x: str) -> str:
    import re

    for a, b in V.CONTRACTIONS.items():
        x = f"regexp_replace({x}, '(?i){re.escape(a).replace(chr(39), chr(39) * 2)}', '{b}', 'g')"
    return x


# Numbers.
_DECIMAL = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def _plain(x: str) -> str:
    return f"CASE WHEN {_has(_strip(x), _DECIMAL)} THEN TRY_CAST({_strip(x)} AS DOUBLE) END"


_CURRENCY = "(?i)" + "|".join([r"\b(?:" + "|".join(w for w in V.CURRENCY_WORDS if w.isascii() and not w.startswith(" ")) + r")\b", r"ج\.م", "ريال", "درهم", "دينار", "جنيه", "ليرة"])
_MIXED = rf"""
    s1 AS (SELECT *, translate({_DIGITS(_strip('v'))}, '٫٬', '.') AS a FROM raw),
    s2 AS (SELECT *, starts_with(a, '(') AND ends_with(a, ')') AS negative, CASE WHEN starts_with(a, '(') AND ends_with(a, ')') THEN regexp_replace(a, '^\(-?(.*)\)$', '\1') ELSE a END AS b FROM s1),
    s3 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(b, '{V.CURRENCY_SIGNS}', '', 'g'), '{_CURRENCY}', '', 'g'), '[^\d.KMBkmb%-]', '', 'g') AS c FROM s2),
    s4 AS (SELECT *, ends_with(c, '%') AS percent, regexp_replace(c, '%$', '') AS d FROM s3),
    s5 AS (SELECT *, upper(right(d, 1)) AS last, regexp_replace(d, '[KMBkmb]$', '') AS e FROM s4),
    s6 AS (SELECT *, CASE WHEN {_has('e', r'^-?\d*\.?\d+\.?$|^-?\d+\.$')} THEN TRY_CAST(e AS DOUBLE) END * CASE last WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1.0 END AS n FROM s5),
    mixed AS (SELECT *, CASE WHEN negative THEN -abs(CASE WHEN percent THEN n / 100.0 ELSE n END) ELSE CASE WHEN percent THEN n / 100.0 ELSE n END END AS number FROM s6)"""


def _phone(compat: bool) -> str:
    codes = " ".join(f"WHEN starts_with(f, '{c}') THEN CASE WHEN length(f) BETWEEN {a} AND {b} THEN f ELSE '' END" for c, (a, b) in V.COUNTRY_LENGTHS.items())
    local = "" if compat else "WHEN starts_with(d, '01') AND length(d) = 11 THEN '+20' || d[2:]"
    full = f"""CASE WHEN starts_with(d, '20') AND length(d) >= 11 THEN '+' || d WHEN (starts_with(d, '966') OR starts_with(d, '971')) AND length(d) >= 12 THEN '+' || d
        WHEN starts_with(d, '1') AND length(d) = 11 THEN '+20' || d[2:] WHEN starts_with(d, '5') AND length(d) = 9 THEN '+966' || d WHEN starts_with(d, '05') AND length(d) = 10 THEN '+966' || d[2:]
        {local} WHEN NOT starts_with(d, '+') THEN '+20' || d ELSE d END"""
    return f"SELECT c_custkey, CASE {codes} WHEN starts_with(f, '+') AND length(f) BETWEEN 10 AND 15 THEN f ELSE '' END AS p FROM (SELECT c_custkey, {full} AS f FROM digits)"


# Dates.
_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "%Y-%m-%d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "%d/%m/%Y"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "%m/%d/%Y"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "%d-%m-%Y"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "%Y/%m/%d"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "%d.%m.%Y"), (r"^\d{1,2} \d{1,2} \d{4}$", "%d %m %Y"), (r"^\d{4} \d{1,2} \d{1,2}$", "%Y %m %d"), (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "%Y-%m-%d %H:%M:%S"),
    (r"^[A-Za-z]{3,} \d{1,2}, \d{4}$", "%B %d, %Y"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "%b %d, %Y"), (r"^\d{1,2} [A-Za-z]{3,} \d{4}$", "%d %B %Y"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "%d %b %Y"),
)


def _parse(x: str) -> str:
    """The listed formats, March as an Arabic word, two-digit years of this century, serials."""
    tries = ", ".join(f"CASE WHEN {_has(x, p)} THEN CAST(try_strptime({x}, '{f}') AS DATE) END" for p, f in _FORMATS)
    short = f"CASE WHEN {_has(x, r'^\d{1,2}/\d{1,2}/\d{2}$')} THEN CAST(try_strptime(regexp_replace({x}, '/(\\d{{2}})$', '/20\\1'), '%d/%m/%Y') AS DATE) END"
    arabic = f"CASE WHEN contains({x}, 'مارس') THEN CAST(try_strptime(replace({x}, 'مارس', '3'), '%d %m %Y') AS DATE) END"
    serial = f"CASE WHEN {_has(x, r'^\d{4,6}$')} AND TRY_CAST({x} AS INTEGER) BETWEEN 1 AND {V.EXCEL_LAST} THEN DATE '{V.EXCEL_EPOCH}' + TRY_CAST({x} AS INTEGER) END"
    return f"coalesce({tries}, {short}, {arabic}, {serial})"


_ISO = lambda d: f"strftime({d}, '%Y-%m-%d')"
_DIRTY_LINEITEM = "li AS (SELECT * REPLACE (CASE WHEN l_partkey % 7 = 0 OR l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS l_quantity), nullif(l_returnflag, 'N') AS grade FROM lineitem)"


def _gone(c: str, n: int, k: int) -> str:
    return f"CASE WHEN o_orderkey % {n} = {k} THEN NULL ELSE {c} END AS {c}"


_DIRTY_ORDERS = f"o AS (SELECT o_orderkey, o_custkey, {_gone('o_orderstatus', 9, 4)}, {_gone('o_orderpriority', 5, 2)}, {_gone('o_totalprice', 13, 1)}, o_orderdate FROM orders)"


def _sum(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE)"


def _mode(source: str, keys: str, value: str, name: str) -> str:
    """name AS (keys, m): the most frequent value, the smallest of ties."""
    return f"{name} AS (SELECT {keys}, {value} AS m FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys}, {value} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {value}) = 1)"


_MODE_OF_ALL = lambda source, value: f"(SELECT {value} FROM {source} WHERE {value} IS NOT NULL GROUP BY {value} ORDER BY count(*) DESC, {value} LIMIT 1)"
_RELATED = "r AS (SELECT l_orderkey, l_quantity AS a, l_discount AS b, l_tax, CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 23 = 0 THEN l_quantity * 100 ELSE l_quantity * l_discount END AS c FROM lineitem)"
_SPELT = "p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' ' || upper(p_type[1]) || lower(p_type[2:]) WHEN 1 THEN p_type || '  ' ELSE p_type END AS kind, p_brand[7:9] || CASE p_partkey % 5 WHEN 3 THEN 'a' ELSE '' END AS code FROM part)"
_EVENTS4 = lambda cond: f"e AS (SELECT event_id, user_id, ts, CASE WHEN {cond} THEN value END AS value FROM events)"
_CUST = lambda values: f"SELECT c_custkey, {_picked('c_custkey', values)} AS v FROM customer"

_QUANTILE_MODES = f"WITH {_DIRTY_ORDERS}, q AS (SELECT list_distinct(quantile_cont(coalesce(o_totalprice, 0.0), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges FROM o), x AS (SELECT o.*, greatest(len(list_filter(edges, lambda e: e < coalesce(o_totalprice, 0.0))) - 1, 0) AS bin FROM o, q), {_mode('x', 'o_custkey', 'o_orderstatus', 'm1')}, {_mode('x', 'bin', 'o_orderstatus', 'm2')}, t AS (SELECT x.*, m1.m AS a, m2.m AS b, coalesce(o_orderstatus, m1.m, m2.m) AS v, {_MODE_OF_ALL('o', 'o_orderstatus')} AS g FROM x LEFT JOIN m1 USING (o_custkey) LEFT JOIN m2 USING (bin)), t3 AS (SELECT *, coalesce(v, {{near}}, {{after}}) AS c FROM t WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey))"

ORACLE_SQL: dict[str, str] = {
    "text_missing": f"SELECT c_custkey, {_missing('v', V.MISSING_VALUES)} AS app, {_missing('v', V.IMPUTATION_MISSING)} AS imputer, {_has('v', _PLACEHOLDER)} AS placeholder, CASE WHEN {_strip('v')} = '' OR {_has('v', _PLACEHOLDER)} THEN NULL ELSE v END AS kept, CASE WHEN v IN {_in(V.READER_NA)} THEN NULL ELSE v END AS reader FROM ({_CUST(Q.MISSING)})",
    "text_arabic": f"SELECT c_custkey, {_DIGITS('v')} AS digits, {_arabic('v')} AS arabic, {_ARABIC_PLAIN} AS plain, {_squeeze(f'''translate({_arabic('v')}, 'ؤئ', 'وي')''')} AS sanitised, {_squeeze(f'''translate({_DIGITS('v')}, 'أإآٱةى', 'ااااهي')''')} AS matching, {_language('v')} AS language FROM ({_CUST(Q.NAMES)})",
    "text_english": f"SELECT p_partkey, {_strip('v')} AS stripped, {_english('v')} AS english, {_ENGLISH_SANITISED('v')} AS sanitised, {_MATCHING('v')} AS matching, array_to_string({_first_seen(_KEYWORDS('v'))}, '|') AS keywords FROM (SELECT p_partkey, ' (' || p_name || ', ' || p_type || ')!  ' || p_brand || '.' AS v FROM part)",
    "text_contractions": f"SELECT p_partkey, {_contractions('v')} AS expanded FROM (SELECT p_partkey, {_picked('p_partkey', ('''Can't stop''', '''we won't go''', '''it isn't''', '''they're here''', '''she's in''', '''I'd say''', '''you'll see''', '''we've been''', '''I'm off''', 'w/ milk', 'plain'))} || ' ' || p_name AS v FROM part)",
    "text_documents_words": f"SELECT doc_id, CAST(len(string_split({_ENGLISH_SANITISED('text')}, ' ')) AS BIGINT) AS words, CAST(len(list_distinct({_KEYWORDS('text')})) AS BIGINT) AS keywords, {_language('text')} AS script FROM documents",
    "numeric_mixed": f"WITH raw AS ({_CUST(Q.NUMBERS)}), {_MIXED} SELECT c_custkey, number, {_plain('v')} AS plain, (['True','False','True','False','maybe','True'])[CAST(c_custkey % 6 AS INTEGER) + 1] AS boolean FROM mixed",
    "phone_standard": f"WITH digits AS (SELECT c_custkey, regexp_replace(regexp_replace({_DIGITS('v')}, '[^\\d+]', '', 'g'), '^00', '+') AS d FROM ({_CUST(Q.PHONES)})), a AS ({_phone(True)}), b AS ({_phone(False)}) SELECT c_custkey, a.p AS phone, b.p AS repaired FROM a JOIN b USING (c_custkey)",
    "date_parse": f"SELECT c_custkey, {_ISO('d')} AS parsed, {_ISO('''CASE WHEN year(d) >= 1900 AND d <= DATE '2025-01-01' + 365 THEN d END''')} AS bounded, CASE WHEN {_strip('v')} = '' THEN NULL WHEN d IS NULL THEN 'invalid' WHEN year(d) < 1900 THEN 'ancient' WHEN d > DATE '2025-01-01' + 365 THEN 'future' END AS failure, CASE WHEN c_custkey BETWEEN 1 AND {V.EXCEL_LAST} THEN {_ISO(f'''DATE '{V.EXCEL_EPOCH}' + CAST(c_custkey AS INTEGER)''')} END AS serial FROM (SELECT *, {_parse('v')} AS d FROM ({_CUST(Q.DATES)}))",
    "date_chronology": "SELECT l_shipdate < o_orderdate AS is_chronology_invalid, count(*) AS n, CAST(sum(l_orderkey * 7 + l_linenumber) AS BIGINT) AS checksum FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_shipdate, CAST(o_orderdate AS DATE) AS o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1",
    "date_bounds_log": f"SELECT 'when' AS \"column\", count(*) FILTER (v <> '' AND d IS NULL) AS invalid, count(*) FILTER (d > DATE '2025-01-01' + 365) AS future, count(*) FILTER (year(d) < 1900) AS ancient, count(*) FILTER (CASE WHEN year(d) >= 1900 AND d <= DATE '2025-01-01' + 365 THEN {_ISO('d')} END IS DISTINCT FROM v) AS changed FROM (SELECT *, {_parse('v')} AS d FROM ({_CUST(Q.DATES)}))",
    "detect_predictiveness": f"WITH {_DIRTY_ORDERS} SELECT 'o_orderpriority' AS feature, round(avg(r), 8) AS spread FROM (SELECT count(DISTINCT o_orderstatus) / count(*) AS r FROM o GROUP BY o_orderpriority) UNION ALL SELECT 'o_custkey', round(avg(r), 8) FROM (SELECT count(DISTINCT o_orderstatus) / count(*) AS r FROM o GROUP BY o_custkey)",
    "profile_numeric": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, min({c}) AS min, max({c}) AS max, round(any_value(q1), 2) AS q1, round(median({c}), 2) AS median, round(any_value(q3), 2) AS q3, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)" for c in ("l_quantity", "l_extendedprice", "l_discount")),
    "profile_missing": f"WITH {_DIRTY_ORDERS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS null_count, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_pct FROM o" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")),
    "profile_frequencies": f"WITH {_DIRTY_ORDERS}, c AS (SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM o WHERE o_orderstatus IS NOT NULL GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 2) SELECT *, CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS INTEGER) AS rank FROM c QUALIFY rank <= 3",
    "profile_dropping": "WITH t AS (SELECT o_orderstatus, CASE WHEN o_orderkey % 20 = 0 THEN 'x' END AS rare, CASE WHEN o_orderkey % 100 = 0 THEN 'other' ELSE 'same' END AS flat FROM orders), s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CAST({c} IS NULL AS INT)), 6) AS null_share, (SELECT round(max(n) / sum(n), 6) FROM (SELECT count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c})) AS top_share, count({c}) AS filled FROM t" for c in ("o_orderstatus", "rare", "flat")) + ") SELECT \"column\", null_share, top_share, null_share > 0.9 AS high_missing, top_share > 0.98 AND filled > 1 AS low_variance, null_share > 0.9 OR (top_share > 0.98 AND filled > 1) AS recommend_drop FROM s",
    "profile_languages": f"SELECT 'c_name' AS \"column\", {_language('c_name')} AS language, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'full_name', {_language('v')}, count(*) FROM ({_CUST(Q.NAMES)}) GROUP BY 2",
    "schema_duplicate_columns": "SELECT unnest(['twin', 'other']) AS \"column\"",
    "schema_strict_numeric": "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS total_price, 'double' AS kind, CASE WHEN o_orderkey = 5 THEN 'invalid' ELSE CAST(o_custkey AS VARCHAR) END AS net_amount FROM orders",
    "schema_standard_types": f"SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS number, (['True','False','True','False'])[CAST(c_custkey % 4 AS INTEGER) + 1] AS flag, {_picked('c_custkey', ('yes', 'other'))} AS text FROM customer",
    "schema_typed_notes": "SELECT c_custkey, CAST(([10.0, 20.5, NULL, 1000.0, NULL])[CAST(c_custkey % 5 AS INTEGER) + 1] AS DOUBLE) AS amount, (['2024-02-03', NULL, '2024-01-15'])[CAST(c_custkey % 3 AS INTEGER) + 1] AS due, concat_ws(' | ', CASE WHEN c_custkey % 5 = 2 THEN 'amount: none yet' END, (CASE c_custkey % 3 WHEN 1 THEN 'due: tomorrow' WHEN 2 THEN 'due: time dropped from 2024-01-15 14:30:00' END)) AS \"Notes\" FROM customer",
    "schema_clean_numbers_log": f"WITH raw AS ({_CUST(Q.NUMBERS)}), {_MIXED} SELECT 'amount' AS \"column\", count(number) AS converted, count(v) - count(number) AS invalid FROM mixed",
    "rows_first_of_equal": "SELECT o_custkey, o_orderstatus, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1",
    "rows_duplicate_documents": "SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text)",
    "rows_metrics": f"WITH {_DIRTY_ORDERS} SELECT count(*) AS rows, 6 AS columns, count(*) * 6 AS cells, count(*) * 3 - count(o_orderstatus) - count(o_orderpriority) - count(o_totalprice) AS missing FROM o",
    "rows_preview": "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 100",
    "rows_union": f"SELECT nation, count(*) AS n, {_sum('balance')} AS balance FROM (SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY nation",
    "rows_neighbour": f"WITH {_EVENTS4('event_id % 4 <> 0')} SELECT event_id, coalesce(value, lag(value) OVER w, lead(value) OVER w) AS value FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "rows_carried": f"WITH {_EVENTS4('event_id % 4 = 0')} SELECT event_id, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM e",
    "outlier_global": "SELECT event_id, 'value' AS \"column\", value FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)",
    "outlier_flags": "WITH t AS (SELECT event_id, value, value * value AS square FROM events), q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, quantile_cont(square, 0.25) AS c, quantile_cont(square, 0.75) AS d FROM t), f AS (SELECT event_id, CAST(value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS INT) + CAST(square < c - 1.5 * (d - c) OR square > d + 1.5 * (d - c) AS INT) AS cells FROM t, q) SELECT cells > 0 AS beyond, cells, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM f GROUP BY ALL",
    "outlier_grouped": "WITH t AS (SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN user_id END AS user_id, event_type, value FROM events), a AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM t GROUP BY 1), b AS (SELECT user_id, quantile_cont(value, 0.25) AS r1, quantile_cont(value, 0.75) AS r3 FROM t GROUP BY 1), f AS (SELECT t.event_id, t.event_type, (q3 > q1 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))) OR (r3 > r1 AND (value < r1 - 1.5 * (r3 - r1) OR value > r3 + 1.5 * (r3 - r1))) AS beyond FROM t JOIN a ON t.event_type = a.event_type JOIN b ON t.user_id IS NOT DISTINCT FROM b.user_id) SELECT event_type, beyond, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM f GROUP BY ALL",
    "relation_detect": f"WITH {_RELATED}, s AS (SELECT count(*) AS support, round(avg(CAST(c <> 0 AND abs(a * b - abs(c)) <= 0.04 * abs(c) AS INT)), 6) AS share FROM r WHERE c IS NOT NULL) SELECT 'a' AS a, 'b' AS b, 'c' AS c, support, share FROM s UNION ALL SELECT 'b', 'a', 'c', support, share FROM s",
    "relation_repair": f"WITH {_RELATED}, f AS (SELECT *, a * b AS p, c IS NULL OR abs(c - a * b) > greatest(abs(a * b) * 0.03, 1e-9) AS wrong FROM r) SELECT CASE WHEN wrong AND c IS NULL THEN 'Calculated' WHEN wrong THEN 'Corrected' ELSE 'Original Value' END AS status, count(*) AS n, CAST(sum(CAST(round(CASE WHEN wrong THEN p ELSE c END, 4) AS DECIMAL(18,4))) AS DOUBLE) AS total FROM f GROUP BY 1",
    "impute_hier_median": f"WITH {_DIRTY_LINEITEM}, f AS (SELECT l_partkey, median(l_quantity) AS m1 FROM li GROUP BY 1), g AS (SELECT grade, median(l_quantity) AS m2 FROM li WHERE grade IS NOT NULL GROUP BY 1), a AS (SELECT median(l_quantity) AS m3 FROM li) SELECT l_returnflag, CASE WHEN l_quantity IS NOT NULL THEN 'Original Value' WHEN m1 IS NOT NULL THEN 'Filled by Item Context' WHEN m2 IS NOT NULL THEN 'Filled by Category Context' ELSE 'Filled by Global Median' END AS status, count(*) AS n, {_sum('coalesce(l_quantity, m1, m2, m3)')} AS quantity FROM li LEFT JOIN f USING (l_partkey) LEFT JOIN g USING (grade), a GROUP BY 1, 2",
    "impute_fill": f"WITH {_DIRTY_ORDERS} SELECT coalesce(o_orderstatus, '{V.SENTINEL}') AS o_orderstatus, coalesce(o_orderpriority, '{V.SENTINEL}') AS o_orderpriority, count(*) AS n, {_sum('coalesce(o_totalprice, m)')} AS total FROM o, (SELECT median(o_totalprice) AS m FROM o) GROUP BY 1, 2",
    "impute_mode_context": f"WITH {_DIRTY_ORDERS}, {_mode('o', 'o_custkey, o_orderstatus', 'o_orderpriority', 'm1')}, s1 AS (SELECT o.*, m1.m AS a FROM o LEFT JOIN m1 ON o.o_custkey = m1.o_custkey AND o.o_orderstatus IS NOT DISTINCT FROM m1.o_orderstatus), t1 AS (SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(o_orderpriority, a) AS v, CASE WHEN o_orderpriority IS NOT NULL THEN 'Original Value' WHEN a IS NOT NULL THEN 'Filled by Item Context' END AS s FROM s1), {_mode('t1', 'o_custkey', 'v', 'm2')}, t2 AS (SELECT o_orderkey, o_orderstatus, coalesce(v, m) AS v, CASE WHEN v IS NULL AND m IS NOT NULL THEN 'Filled by Anchor Context' ELSE s END AS s FROM t1 LEFT JOIN m2 USING (o_custkey)), {_mode('t2', 'o_orderstatus', 'v', 'm3')} SELECT o_orderkey, coalesce(v, m) AS o_orderpriority, CASE WHEN v IS NULL AND m IS NOT NULL THEN 'Filled by Anchor Context' ELSE s END AS status FROM t2 LEFT JOIN m3 USING (o_orderstatus)",
    "impute_waterfall": f"WITH e AS (SELECT event_id, user_id, ts, CASE WHEN user_id % 6 = 0 OR event_id % 10 = 3 THEN NULL ELSE value END AS value, CASE WHEN event_id % 3 <> 0 THEN event_type END AS kind FROM events), m1 AS (SELECT user_id, median(value) AS a FROM e GROUP BY 1), t1 AS (SELECT e.*, a, coalesce(value, a) AS v1 FROM e LEFT JOIN m1 USING (user_id)), m2 AS (SELECT kind, median(v1) AS b FROM t1 GROUP BY 1), t2 AS (SELECT t1.*, b, coalesce(v1, b) AS v2 FROM t1 LEFT JOIN m2 ON t1.kind IS NOT DISTINCT FROM m2.kind), t3 AS (SELECT *, coalesce(v2, lag(v2) OVER w, lead(v2) OVER w) AS c FROM t2 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT CASE WHEN value IS NOT NULL THEN 'Populated' WHEN a IS NOT NULL THEN 'Filled by Item Context' WHEN b IS NOT NULL THEN 'Filled by Category Fallback' WHEN c IS NOT NULL THEN 'Filled by Sequential Neighbor' ELSE 'Filled by Global Median' END AS status, count(*) AS n, {_sum('coalesce(value, a, b, c, g)')} AS total FROM t3, (SELECT median(value) AS g FROM e) GROUP BY 1",
    "impute_siblings": f"WITH {_DIRTY_ORDERS}, a AS (SELECT o_custkey, count(*) AS n FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 1), b AS (SELECT o_orderstatus, count(*) AS n FROM o WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1), {_mode('o', 'o_custkey', 'o_orderpriority', 'ma')}, {_mode('o', 'o_orderstatus', 'o_orderpriority', 'mb')} SELECT o_orderkey, coalesce(o_orderpriority, CASE WHEN coalesce(b.n, 0) > coalesce(a.n, 0) THEN mb.m ELSE ma.m END, '{V.SENTINEL}') AS o_orderpriority, o_orderpriority IS NULL AND (ma.m IS NOT NULL OR mb.m IS NOT NULL) AS predicted FROM o LEFT JOIN a USING (o_custkey) LEFT JOIN ma USING (o_custkey) LEFT JOIN b USING (o_orderstatus) LEFT JOIN mb USING (o_orderstatus)",
    "impute_from_descriptions": f"WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 4 <> 0 THEN string_split(p_name, ' ')[1] END AS colour FROM part), known AS (SELECT DISTINCT lower(colour) AS w FROM p WHERE colour IS NOT NULL AND length(colour) >= 2), hit AS (SELECT p_partkey, min(w) AS w FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM p WHERE colour IS NULL) JOIN known USING (w) GROUP BY 1) SELECT p_partkey, coalesce(colour, upper(w[1]) || w[2:], '{V.SENTINEL}') AS colour, colour IS NULL AND w IS NOT NULL AS predicted FROM p LEFT JOIN hit USING (p_partkey)",
    "bins_quantile": "WITH e AS (SELECT quantile_cont(o_totalprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT greatest(len(list_filter(list_distinct(q), lambda x: x < o_totalprice)) - 1, 0)::INT AS bin, least(floor((o_totalprice - lo) * 4 / (hi - lo)), 3)::INT AS band, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders, e GROUP BY 1, 2",
    "audit_changes": f"WITH {_DIRTY_ORDERS} SELECT o_orderkey, 'o_orderstatus' AS \"column\", CAST(NULL AS VARCHAR) AS old_value, '{V.SENTINEL}' AS new_value FROM o WHERE o_orderstatus IS NULL UNION ALL SELECT o_orderkey, 'o_orderpriority', NULL, '{V.SENTINEL}' FROM o WHERE o_orderpriority IS NULL",
    "audit_report": f"WITH {_DIRTY_ORDERS} SELECT 'status filled' AS reason, 'o_orderstatus' AS \"column\", count(*) AS changes FROM o WHERE o_orderstatus IS NULL UNION ALL SELECT 'priority filled', 'o_orderpriority', count(*) FROM o WHERE o_orderpriority IS NULL",
    "audit_styles": f"WITH {_DIRTY_ORDERS} SELECT o_orderkey, 'o_orderpriority' AS \"column\", CASE WHEN o_custkey % 2 = 0 THEN 'imputed' ELSE 'missing' END AS kind FROM o WHERE o_orderpriority IS NULL UNION ALL SELECT o_orderkey, 'o_orderstatus', 'missing' FROM o WHERE o_orderstatus IS NULL UNION ALL SELECT o_orderkey, 'o_totalprice', 'missing' FROM o WHERE o_totalprice IS NULL",
    "audit_notes": "SELECT c_custkey, concat_ws(' | ', CASE WHEN c_custkey % 3 = 1 THEN 'amount: ten is no numeric' END, CASE WHEN c_custkey % 2 = 1 THEN 'due: later is no date' END) AS \"Notes\" FROM customer",
    "audit_many_nulls": f"WITH {_DIRTY_ORDERS}, s AS (SELECT 'o_orderpriority' AS \"column\", round(avg(CAST(o_orderpriority IS NULL AS INT)), 6) AS null_share FROM o UNION ALL SELECT 'o_orderstatus', round(avg(CAST(o_orderstatus IS NULL AS INT)), 6) FROM o UNION ALL SELECT 'o_totalprice', round(avg(CAST(o_totalprice IS NULL AS INT)), 6) FROM o) SELECT * FROM s WHERE null_share > 0.1",
    "export_widths": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(least(greatest(greatest(max(length(CAST({c} AS VARCHAR))), {len(c)}) + 2, 10), 50) AS INTEGER) AS width FROM orders" for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")),
    "export_text": f"WITH {_DIRTY_ORDERS} SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(o_orderpriority, '') AS o_orderpriority FROM o",
    "export_json": "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation",
    "cluster_norm_exact": f"WITH {_SPELT}, r AS (SELECT trim(kind) AS raw, lower(trim(kind)) AS normal, count(*) AS n FROM p GROUP BY ALL) SELECT raw, normal, n, first_value(raw) OVER (PARTITION BY normal ORDER BY n DESC, raw) AS master FROM r",
    "cluster_levenshtein": f"WITH {_SPELT}, v AS (SELECT DISTINCT trim(code) AS c FROM p) SELECT a.c AS a, b.c AS b, CAST(levenshtein(a.c, b.c) AS INTEGER) AS distance FROM v a JOIN v b ON a.c < b.c WHERE (length(a.c) < 4 OR length(b.c) < 4) AND levenshtein(a.c, b.c) <= 1",
    "cluster_majority": "SELECT CASE WHEN c_custkey % 10 = 0 OR c_custkey % 3 <> 0 THEN 'furniture' ELSE 'machinery' END AS segment, count(*) AS n FROM customer GROUP BY 1",
    "pipeline_polish": "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders",
    "pipeline_typed_engine": "SELECT count(*) * 2 AS cells_checked, count(*) FILTER (c_custkey % 4 <> 1) AS cells_modified FROM customer",
    "date_cells": f"SELECT c_custkey, nullif({_picked('c_custkey', ('2024-09-22', '-', '2024-01-01', '2024-03-15', '2024-08-25', '2024-01-15', '2024-07-27', '-'))}, '-') AS \"when\", nullif({_picked('c_custkey', ('Extracted Embedded Date', 'Coerced Text to Null', 'Corrected Year Typo', 'Corrected Year Typo', '-', 'Stripped Time', 'Extracted Embedded Date', 'Coerced Text to Null'))}, '-') AS action_taken FROM customer",
    "impute_grouped_median": f"WITH {_DIRTY_LINEITEM}, f AS (SELECT l_partkey, median(l_quantity) AS m1 FROM li GROUP BY 1), g AS (SELECT l_returnflag, median(l_quantity) AS m2 FROM li GROUP BY 1) SELECT CASE WHEN l_quantity IS NOT NULL THEN 'Original Value' WHEN m1 IS NOT NULL THEN 'Filled by Grouped Median (l_partkey)' ELSE 'Filled by Grouped Median (l_returnflag)' END AS status, count(*) AS n, {_sum('coalesce(l_quantity, m1, m2)')} AS quantity FROM li LEFT JOIN f USING (l_partkey) LEFT JOIN g USING (l_returnflag) GROUP BY 1",
    "impute_transactions": f"WITH {_DIRTY_LINEITEM}, f AS (SELECT l_partkey, median(l_quantity) AS a FROM li GROUP BY 1), g AS (SELECT grade, median(l_quantity) AS b FROM li WHERE grade IS NOT NULL GROUP BY 1), t AS (SELECT *, coalesce(lag(l_quantity) OVER w, lead(l_quantity) OVER w) AS c FROM li WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) SELECT CASE WHEN l_quantity IS NOT NULL THEN 'Original' WHEN a IS NOT NULL THEN 'Filled by Item Context' WHEN b IS NOT NULL THEN 'Filled by Category Context' WHEN c IS NOT NULL THEN 'Filled by Transaction Neighbor' ELSE 'Filled Globally' END AS status, count(*) AS n FROM t LEFT JOIN f USING (l_partkey) LEFT JOIN g USING (grade) GROUP BY 1",
    "impute_carried": f"WITH e AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 10 <> 3 THEN value END AS value, CASE WHEN event_id % 7 <> 0 THEN event_type END AS kind FROM events), f AS (SELECT user_id, median(value) AS a FROM e GROUP BY 1), g AS (SELECT event_type, median(value) AS b FROM e GROUP BY 1), {_mode('e', 'user_id', 'kind', 'm')} SELECT CASE WHEN value IS NOT NULL THEN 'Original Value' WHEN a IS NOT NULL THEN 'Filled by Item Context' ELSE 'Filled by Category Context' END AS value_status, CASE WHEN kind IS NOT NULL THEN 'Original Value' ELSE 'Filled by Item Context' END AS kind_status, coalesce(kind, m) AS kind, count(*) AS n, {_sum('coalesce(value, a, b)')} AS total FROM e LEFT JOIN f USING (user_id) LEFT JOIN g USING (event_type) LEFT JOIN m USING (user_id) GROUP BY 1, 2, 3",
    "quality_score": f"WITH {_DIRTY_ORDERS}, c AS (SELECT count(*) AS n, 2 * count(*) FILTER (o_orderstatus IS NULL) + count(*) FILTER (o_orderpriority IS NULL) AS gone FROM o), d AS (SELECT count(*) AS k FROM (SELECT DISTINCT o_orderstatus, o_orderpriority, o_custkey FROM o)), s AS (SELECT round(gone / (n * 4), 6) AS missing, gone / (n * 4) AS a, (n - k) / n AS b FROM c, d) SELECT round(40 * (1 - a) + 20 * (1 - b) + 10 * 0.75 + 30 * 0.75, 1) AS score, missing, round(b, 6) AS duplicates, 0.25::DOUBLE AS duplicate_columns, 0.25::DOUBLE AS numbers_as_text FROM s",
    "impute_quantile_modes": f"{_QUANTILE_MODES.format(near='lag(v) OVER w', after='lead(v) OVER w')} SELECT o_orderkey, coalesce(v, c, g) AS o_orderstatus, CASE WHEN o_orderstatus IS NOT NULL THEN 'Populated' WHEN a IS NOT NULL THEN 'Filled by Item Context' WHEN b IS NOT NULL THEN 'Filled by Numeric Bin' WHEN c IS NOT NULL THEN 'Filled by Sequential Neighbor' ELSE 'Filled by Global Mode' END AS status FROM t3",
    "impute_number_bins": f"{_QUANTILE_MODES.format(near='CASE WHEN o_orderpriority IS NOT NULL THEN lag(o_orderstatus) OVER w END', after='CASE WHEN o_orderpriority IS NOT NULL THEN lead(o_orderstatus) OVER w END')} SELECT o_orderkey, coalesce(v, c, g) AS o_orderstatus, CASE WHEN o_orderstatus IS NOT NULL THEN 'Populated' WHEN a IS NOT NULL THEN 'Filled by Item Context' WHEN b IS NOT NULL THEN 'Filled by Numeric Bin' WHEN c IS NOT NULL THEN 'Filled by Sequential Neighbor' ELSE 'Filled by Global Mode' END AS status FROM t3",
    "impute_by_features": f"WITH {_DIRTY_ORDERS}, t AS (SELECT *, coalesce(o_orderpriority, CASE WHEN lag(o_orderstatus) OVER w IS NOT DISTINCT FROM o_orderstatus THEN lag(o_orderpriority) OVER w END, CASE WHEN lead(o_orderstatus) OVER w IS NOT DISTINCT FROM o_orderstatus AND lead(o_custkey) OVER w IS NOT NULL THEN lead(o_orderpriority) OVER w END) AS n FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), {_mode('o', 'o_custkey, o_orderstatus', 'o_orderpriority', 'm0')}, {_mode('o', 'o_orderstatus', 'o_orderpriority', 'm1')}, f AS (SELECT t.o_orderpriority AS v, n, m0.m AS a, m1.m AS b, {_MODE_OF_ALL('o', 'o_orderpriority')} || '_Estimated' AS g FROM t LEFT JOIN m0 ON t.o_custkey = m0.o_custkey AND t.o_orderstatus IS NOT DISTINCT FROM m0.o_orderstatus LEFT JOIN m1 ON t.o_orderstatus IS NOT DISTINCT FROM m1.o_orderstatus) SELECT coalesce(n, a, b, g) AS o_orderpriority, CASE WHEN v IS NOT NULL THEN 'Original' WHEN n IS NOT NULL THEN 'Neighbor Match' WHEN a IS NOT NULL THEN 'Multi-Feature Matrix' WHEN b IS NOT NULL THEN 'Relaxed Feature Match' ELSE 'Global Mode Fallback' END AS how, count(*) AS n FROM f GROUP BY 1, 2",
    "impute_highlighted": f"WITH {_DIRTY_ORDERS}, {_mode('o', 'o_custkey', 'o_orderpriority', 'm1')} SELECT o_orderkey, CASE WHEN o_orderpriority IS NULL AND m IS NOT NULL THEN 'o_orderpriority' ELSE '' END AS highlight FROM o LEFT JOIN m1 USING (o_custkey)",
    "schema_types": " UNION ALL ".join([f"SELECT '{c}' AS \"column\", '{k}' AS type, CASE WHEN max({c}) <= 127 AND min({c}) >= -128 THEN 'tinyint' WHEN max({c}) <= 32767 AND min({c}) >= -32768 THEN 'smallint' WHEN max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS recommended FROM lineitem" for c, k in (("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"))] + [f"SELECT '{c}', 'double', CASE WHEN bool_and(CAST(CAST({c} AS FLOAT) AS DOUBLE) = {c}) THEN 'float' ELSE 'double' END FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")] + [f"SELECT '{c}', 'string', CASE WHEN count(DISTINCT {c}) <= 0.2 * count(*) THEN 'dictionary_candidate' ELSE 'string' END FROM lineitem" for c in ("l_returnflag", "l_linestatus")]),
    "detect_roles": f"WITH {_DIRTY_ORDERS}, c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", lower(CAST({c} AS VARCHAR)) AS v, count(*) AS n FROM o WHERE {c} IS NOT NULL GROUP BY 2" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")) + ") SELECT \"column\", CASE WHEN \"column\" IN ('o_orderkey', 'o_custkey', 'o_totalprice') THEN 'numeric' ELSE 'categorical' END AS role, CAST(sum(n) AS BIGINT) AS filled, round(count(*) / sum(n), 6) AS distinct_ratio, round(max(n) / sum(n), 6) AS top_share FROM c GROUP BY 1",
    "detect_types": "SELECT * FROM (VALUES ('o_orderkey', 'numeric', 'numeric', 'other'), ('shipped', 'date', 'date', 'other'), ('o_totalprice', 'numeric', 'numeric', 'other'), ('o_orderpriority', 'text', 'text', 'en'), ('flag', 'boolean', 'text', 'other')) t(\"column\", type, engine_type, language)",
    "phone_log": f"WITH digits AS (SELECT c_custkey, v, regexp_replace(regexp_replace({_DIGITS('v')}, '[^\\d+]', '', 'g'), '^00', '+') AS d FROM ({_CUST((*Q.PHONES, ''))})), a AS ({_phone(True)}) SELECT count(*) FILTER (p <> v) AS phones_standardized, count(*) FILTER (p = '' AND v <> '') AS invalid_phones, count(*) FILTER (v = '') AS empty_phones FROM a JOIN digits USING (c_custkey)",
    "schema_empty_cells": f"SELECT c_custkey, nullif({_picked('c_custkey', ('100', '-', '-', '', '500', '-', '-', 'n/a', '-'))}, '-') AS quantity, nullif({_picked('c_custkey', ('a', '', 'N/A', 'null'))}, '') AS label FROM customer",
    "rows_filter_outliers": "SELECT event_id, user_id, value FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)",
    "cluster_phones": f"SELECT CASE WHEN v = '+201012345678' THEN '+20101234567' ELSE v END AS phone, count(*) AS n FROM ({_CUST(('+201012345678', '+201012345678', '+20101234567', '+966512345678', 'none'))}) GROUP BY 1",
}


def _rows(columns: str, *values: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({v})' for v in values)}) t({columns})"


def _pick(values: Sequence[str], alias: str) -> str:
    return f"{_picked('c_custkey', values)} AS {alias}"


#: Spellings with one meaning: what each value of the queries becomes. Counts decide, as every value stands for as many rows as it has places.
_BRANDS_TO = ("red car", "red car", "red car", "red car", "blue bike", "blue bike", "blue bike", "blue bike", "green boat")
_DEVICES_TO = ("Wireless Mouse", "Wireless Mouse", "Wireless Mouse", "Wireless Mouse", "Keyboard", "Keyboard", "Keyboard", "Wireless Mouse", "Lamp")
_SEGMENT = "CASE WHEN c_custkey % 10 = 0 THEN ' furnitur' WHEN c_custkey % 10 = 7 THEN 'furnitur' WHEN c_custkey % 3 = 0 THEN 'machinery' ELSE 'furniture' END"
_CLEAN_NUMBER = "TRY_CAST(regexp_replace(v, '[,\\s]', '', 'g') AS DOUBLE)"


def _violations(values: Sequence[str]) -> str:
    return f"raw AS (SELECT c_custkey, nullif({_picked('c_custkey', values)}, '?') AS v FROM customer), x AS (SELECT *, {_CLEAN_NUMBER} AS number FROM raw)"


_LEGACY_CATEGORY = f"WITH {_DIRTY_ORDERS}, {_mode('o', 'o_custkey', 'o_orderstatus', 'm1')}, t AS (SELECT o.*, m1.m AS a, coalesce(o_orderstatus, m1.m) AS v FROM o LEFT JOIN m1 USING (o_custkey)), t2 AS (SELECT *, coalesce(lag(v) OVER w, lead(v) OVER w) AS c FROM t WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_orderkey, coalesce(v, c, {_MODE_OF_ALL('o', 'o_orderstatus')}) AS o_orderstatus, CASE WHEN o_orderstatus IS NOT NULL THEN NULL WHEN a IS NOT NULL THEN 'Filled by Item Context' WHEN c IS NOT NULL THEN 'Filled by Sequential Neighbor' ELSE 'Populated' END AS status FROM t2"

ORACLE_SQL |= {
    "detect_polish_columns": _rows('"column", kind', "'shipped', 'date'", "'birthday', 'date'", "'o_orderdate', 'date'", "'o_orderkey', 'numeric'", "'o_totalprice', 'numeric'"),
    "detect_engine_columns": _rows('"column", kind', "'c_custkey', 'numeric'", "'mostly', 'numeric'", "'moment', 'date'"),
    "detect_digits_and_letters": _rows('"column"', "'c_name'", "'either'", "'arabic'"),
    "detect_guides": _rows('role, "column"', "'fine', 'Product Name'", "'coarse', 'Category'", "'phone', 'Mobile No'"),
    "schema_thresholds": """
        WITH f AS (SELECT count(*) AS n, min(l_orderkey) AS a, max(l_orderkey) AS b, max(abs(l_quantity)) AS q, max(abs(l_extendedprice * 1000)) AS w, count(DISTINCT l_returnflag) AS r, count(DISTINCT l_orderkey || '-' || l_linenumber) AS d FROM lineitem)
        SELECT 'l_orderkey' AS "column", 'bigint' AS type, CASE WHEN a >= -2147483648 AND b <= 2147483647 THEN 'int' ELSE 'bigint' END AS recommended FROM f
        UNION ALL SELECT 'l_linenumber', 'int', 'int' UNION ALL SELECT 'l_quantity', 'double', CASE WHEN q < 1e6 THEN 'float' ELSE 'double' END FROM f
        UNION ALL SELECT 'wide', 'double', CASE WHEN w < 1e6 THEN 'float' ELSE 'double' END FROM f
        UNION ALL SELECT 'l_returnflag', 'string', CASE WHEN r < 0.5 * n THEN 'dictionary_candidate' ELSE 'string' END FROM f
        UNION ALL SELECT 'label', 'string', CASE WHEN d < 0.5 * n THEN 'dictionary_candidate' ELSE 'string' END FROM f""",
    "schema_downcast": """
        SELECT CASE WHEN min(l_orderkey) >= -128 AND max(l_orderkey) <= 127 THEN 'tinyint' WHEN min(l_orderkey) >= -32768 AND max(l_orderkey) <= 32767 THEN 'smallint' WHEN min(l_orderkey) >= -2147483648 AND max(l_orderkey) <= 2147483647 THEN 'int' ELSE 'bigint' END AS key_type,
               CASE WHEN min(l_linenumber) >= -128 AND max(l_linenumber) <= 127 THEN 'tinyint' ELSE 'int' END AS line_type, CASE WHEN bool_and(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) = l_quantity) THEN 'float' ELSE 'double' END AS quantity_type,
               CAST(sum(l_orderkey) AS BIGINT) AS keys, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem""",
    "schema_number_violations": f"WITH {_violations(('10', '20.5', 'none yet', '1,000', '?', '1 2', ''))} SELECT c_custkey, CASE WHEN v IS NULL THEN median(number) OVER () ELSE number END AS amount, CASE WHEN v IS NOT NULL AND number IS NULL THEN 'amount: ''' || v || ''' is no number' ELSE '' END AS Notes FROM x",
    "schema_number_cells": f"WITH {_violations(('10', '20.5', 'none yet', '1,000', '?', '1 2', '11', '12', '13', '14'))}, q AS (SELECT quantile_cont(number, 0.25) AS q1, quantile_cont(number, 0.75) AS q3 FROM x) SELECT c_custkey, 'amount' AS \"column\", v AS value, 'missing' AS kind FROM x WHERE v IS NULL UNION ALL SELECT c_custkey, 'amount', v, 'violation' FROM x WHERE v IS NOT NULL AND number IS NULL UNION ALL SELECT c_custkey, 'amount', CASE number WHEN 1000 THEN '1000.0' ELSE CAST(number AS VARCHAR) END, 'outlier' FROM x, q WHERE q3 > q1 AND (number < q1 - 1.5 * (q3 - q1) OR number > q3 + 1.5 * (q3 - q1))",
    "impute_legacy_numbers": f"WITH {_DIRTY_ORDERS}, f AS (SELECT o_custkey, median(o_totalprice) AS a FROM o GROUP BY 1), g AS (SELECT o_orderpriority, median(o_totalprice) AS b FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 1), h AS (SELECT median(o_totalprice) AS d FROM o) SELECT o_orderkey, round(coalesce(o_totalprice, a, b, d), 4) AS o_totalprice, CASE WHEN o_totalprice IS NOT NULL THEN NULL WHEN a IS NOT NULL THEN 'Filled by Item Context' WHEN b IS NOT NULL THEN 'Filled by Category Fallback' ELSE 'Populated' END AS status FROM o LEFT JOIN f USING (o_custkey) LEFT JOIN g USING (o_orderpriority), h",
    "impute_legacy_categories": _LEGACY_CATEGORY,
    "outlier_rows": "SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)",
    "audit_shifted": f"WITH {_DIRTY_ORDERS} SELECT o_orderkey, 'o_orderstatus' AS \"column\", CAST(NULL AS VARCHAR) AS old_value, '{V.SENTINEL}' AS new_value FROM o WHERE o_orderstatus IS NULL",
    "audit_fixed_dates": f"SELECT c_custkey, {_picked('c_custkey', ('2024-02-03', '2020-03-15', '2023-01-05', 'soon', ''))} AS \"when\" FROM customer",
    "cluster_majority_blanks": f"SELECT c_custkey, CASE WHEN trim(s) = 'furnitur' THEN 'furniture' ELSE s END AS segment FROM (SELECT c_custkey, {_SEGMENT} AS s FROM customer)",
    "cluster_before_after": f"SELECT 'furnitur' AS old_value, 'furniture' AS new_value, count(*) AS n FROM customer WHERE trim({_SEGMENT}) = 'furnitur' HAVING count(*) > 0",
    "cluster_shown": "SELECT 'segment' AS \"column\", 'furnitur -> furniture (sequence)' AS line",
    "cluster_token_words": f"SELECT c_custkey, {_pick(_BRANDS_TO, 'label')} FROM customer",
    "cluster_weighted": f"SELECT c_custkey, {_pick(_DEVICES_TO, 'device')} FROM customer",
    "cluster_semantic_words": f"SELECT c_custkey, {_pick(_DEVICES_TO, 'device')} FROM customer",
    "cluster_summary": "SELECT 'device' AS \"column\", CAST(3 AS BIGINT) AS corrections, CAST(2 AS BIGINT) AS masters",
    "text_forms_of_scripts": f"SELECT c_custkey, {_pick(('fine', 'A1', 'café', 'naïve No5', 'سؤال', 'plain'), 'nfkc')}, {_picked('c_custkey', Q.SCRIPTS)} || '!' AS shown, {_picked('c_custkey', ('Fine', 'Ａ１', 'Café', 'Naïve №5', 'سؤال', 'Plain'))} || '''S O''Neil' AS title FROM customer",
    "export_report": f"WITH {_DIRTY_ORDERS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS null_count, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_pct FROM o" for c in ("o_orderstatus", "o_orderpriority", "o_totalprice")),
    "export_styles": f"WITH {_DIRTY_ORDERS} SELECT 'o_orderstatus' AS \"column\", o_orderkey, 'missing' AS kind, least(greatest(length('o_orderstatus') + 2, 10), 50) AS width FROM o WHERE o_orderstatus IS NULL",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "headers_of_any_kind": f"WITH {_DIRTY_ORDERS} " + " UNION ALL ".join(f"SELECT '{name}' AS \"column\", count(*) FILTER ({c} IS NULL) AS null_count, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_pct FROM o" for name, c in (("o_orderkey", "o_orderkey"), ("Status No.", "o_orderkey"), ("a`b", "o_orderpriority"), ("Total [EUR]", "o_totalprice"))),
    "pipeline_second_engine": f"SELECT c_custkey, TRY_CAST({_picked('c_custkey', ('10', '20.5', '?', '1000', '11', '12', '13', '14'))} AS DOUBLE) AS level, {_pick(('2024-02-03', '2021-06-05'), 'moment')}, 'red car' AS label, CASE WHEN c_custkey % 8 = 2 THEN 'level: ''none yet'' is no number' ELSE '' END AS Notes FROM customer",
    "pipeline_clean_data": f"SELECT c_custkey AS id, 'C' || c_custkey AS code, CAST(c_custkey AS DOUBLE) AS total_price, {_pick(('+201012345678', '', ''), 'phone')}, {_pick(('Red Car', 'Red Car', 'Red Car', 'Blue Bike'), 'goods')}, {_pick(('Vehicle', 'Vehicle', 'Vehicle', 'Vehicle'), 'category')}, {_pick(('2024-02-03', '2020-03-15', 'soon'), 'order_date')}, false AS beyond FROM customer",
    "cluster_names": "WITH c AS (SELECT CASE WHEN c_custkey % 5 < 3 THEN 'John Smith' WHEN c_custkey % 5 = 3 THEN 'Mary Jones' ELSE 'Marry Jones' END AS name FROM customer), n AS (SELECT count(*) FILTER (name = 'Mary Jones') AS a, count(*) FILTER (name = 'Marry Jones') AS b FROM c) SELECT CASE WHEN name = 'John Smith' THEN name WHEN b >= a THEN 'Marry Jones' ELSE 'Mary Jones' END AS name, count(*) AS n FROM c, n GROUP BY 1",
    "detect_grouping": f"WITH {_DIRTY_LINEITEM}, w AS (SELECT var_samp(l_extendedprice) AS v, count(l_extendedprice) AS k FROM li) "
    + " UNION ALL ".join(f"SELECT '{g}' AS \"group\", round(var_samp(m) / any_value(w.v) * count(*) / any_value(w.k), 6) AS score FROM (SELECT median(l_extendedprice) OVER (PARTITION BY {g}) AS m FROM li WHERE {g} IS NOT NULL AND l_extendedprice IS NOT NULL), w" for g in ("l_quantity", "l_returnflag", "l_linenumber", "l_partkey")),
    "pipeline_clustering": _rows('"column", old_value, new_value, method, score', "'device', 'wireless mouse', 'Wireless Mouse', 'weighted_ratio', 85.714::DOUBLE", "'device', 'Wireles Mouse', 'Wireless Mouse', 'weighted_ratio', 96.296::DOUBLE", "'device', 'Keybord', 'Keyboard', 'weighted_ratio', 93.333::DOUBLE"),
    "detect_evidence": f"WITH x AS (SELECT 'amount_text' AS \"column\", {_pick(Q.NUMBERS, 'v')} FROM customer UNION ALL SELECT 'contact', {_picked('c_custkey', Q.PHONES)} FROM customer UNION ALL SELECT 'mail', c_name || '@example.com' FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'active', CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END FROM customer), "
    + f"s AS (SELECT *, {_strip('v')} AS s FROM x) SELECT \"column\", count(*) AS total, count(v) AS filled, count(DISTINCT v) AS distinct_values, round(avg(CAST({_has('s', V.NUMBER)} AS INT)), 6) AS numbers, round(avg(CAST(lower(s) IN {_in(tuple(V.BOOLEANS))} AS INT)), 6) AS booleans, round(avg(CAST({_has('s', V.EMAIL)} AS INT)), 6) AS emails, round(avg(length(s)), 6) AS mean_length, round(avg(CAST({_language('s')} = 'en' AS INT)), 6) AS english FROM s GROUP BY 1",
    "profile_whole": " UNION ALL ".join(
        [f"SELECT '{c}' AS \"column\", 'text' AS type, count(*) AS total, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS \"unique\", CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS BIGINT) AS outliers, (SELECT string_agg(v, '|' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, v LIMIT 5)) AS top FROM customer" for c in ("c_name", "c_mktsegment")]
        + [f"SELECT '{c}', 'numeric', count(*), count(*) - count({c}), count(DISTINCT {c}), round(avg({c}), 2), round(median({c}), 2), count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)), NULL FROM customer, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM customer)" for c in ("c_nationkey", "c_acctbal")]
    ),
    "pipeline_clean_audit": " UNION ALL ".join(
        f"SELECT '{column}' AS \"column\", {old} AS old_value, '{new}' AS new_value, count(*) AS n FROM customer WHERE c_custkey % {n} = {k}" + (" AND c_custkey % 4 <> 3" if column == "category" and k != 3 else "")
        for column, old, new, n, k in (
            ("phone", "'01012345678'", "", 3, 1), ("phone", "'12345'", "", 3, 2), ("goods", "'red car'", "Red Car", 4, 0), ("goods", "'car red'", "Red Car", 4, 1), ("goods", "' red car'", "Red Car", 4, 2), ("goods", "'blue bike'", "Blue Bike", 4, 3),
            ("order_date", "'15/03/2020'", "2020-03-15", 3, 1), ("category", "'vehicle'", "Vehicle", 1, 0), ("category", "CAST(NULL AS VARCHAR)", "Vehicle", 4, 3),
        )
    ),
    "impute_universal": f"WITH {_DIRTY_ORDERS}, c AS (SELECT o_orderpriority AS p, lower(o_orderstatus) AS v, count(*) AS n FROM o WHERE o_orderstatus IS NOT NULL GROUP BY ALL), m AS (SELECT p, v AS m FROM c QUALIFY row_number() OVER (PARTITION BY p ORDER BY n DESC, v) = 1) SELECT coalesce(lower(o_orderstatus), m) AS o_orderstatus, CASE WHEN o_orderstatus IS NOT NULL THEN 'Original Value' WHEN m IS NOT NULL THEN 'Filled by Item Context' END AS status, count(*) AS n FROM o LEFT JOIN m ON o_orderpriority IS NOT DISTINCT FROM p GROUP BY 1, 2",
}
