"""DuckDB SQL of the span rules, for the queries' oracle: written with list functions, apart from the engine's own expressions."""

from __future__ import annotations

from docsieve.functions import checks, rules as R, vocabulary
from docsieve.functions.rules import SEVERITY_SCORE, Rule
from docsieve.sources.rule_packs import Field, Packs, Secret


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _weighted(v: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"{w} * substr(regexp_replace({v}, '[^0-9]', '', 'g'), {k + 1}, 1)::INT" for k, w in enumerate(weights)) + ")"


_DIGITS = "string_split(reverse(m), '')"
CHECKS = {
    "luhn": f"list_sum(list_transform({_DIGITS}, lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT < 5 THEN 2 * c::INT ELSE 2 * c::INT - 9 END)) % 10 = 0",
    "ipv4": "list_max(list_transform(string_split(m, '.'), lambda x: x::INT)) <= 255",
    "entropy": "list_sum(list_transform(list_distinct(string_split(m, '')), lambda c: -(length(m) - length(replace(m, c, ''))) / length(m)::DOUBLE * log2((length(m) - length(replace(m, c, ''))) / length(m)::DOUBLE))) >= 3.0",
    "nric": f"substr(m, 9, 1) = substr(CASE WHEN m[1] IN ('S', 'T') THEN 'JZIHGFEDCBA' WHEN m[1] IN ('F', 'G') THEN 'XWUTRQPNMLK' ELSE 'XWUTRQPNJLK' END, (({_weighted('m', [2, 7, 6, 5, 4, 3, 2])} + CASE WHEN m[1] IN ('T', 'G') THEN 4 WHEN m[1] = 'M' THEN 3 ELSE 0 END) % 11 + 1)::INT, 1)",
    "us_ssn": "m[1:3]::INT > 0 AND m[1:3] <> '666' AND m[1:3]::INT < 900 AND m[5:6] <> '00' AND m[8:11] <> '0000' AND m NOT IN ('078-05-1120', '219-09-9999')",
    "au_tfn": f"{_weighted('m', [1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0",
    "au_abn": f"({_weighted('m', [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19])} - 10) % 89 = 0",
    "cn_resident_id": f"upper(m[18]) = substr('10X98765432', ({_weighted('m[1:17]', [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2])} % 11 + 1)::INT, 1)",
    "iso_date": "try_cast(m AS DATE) IS NOT NULL AND year(try_cast(m AS DATE)) BETWEEN 1900 AND 2100",
    "us_ein": f"m[1:2] IN ({', '.join(map(quoted, checks.EIN_PREFIXES))})",
    "us_itin": "m[5:6]::INT BETWEEN 50 AND 65 OR m[5:6]::INT BETWEEN 70 AND 88 OR m[5:6]::INT BETWEEN 90 AND 92 OR m[5:6]::INT >= 94",
    "uk_nin": "m[1] NOT IN ('D', 'F', 'I', 'Q', 'U', 'V') AND m[2] NOT IN ('D', 'F', 'I', 'Q', 'U', 'V', 'O') AND m[1:2] NOT IN ('BG', 'GB', 'KN', 'NK', 'NT', 'TN', 'ZZ')",
    "au_acn": f"({_weighted('m', [8, 7, 6, 5, 4, 3, 2, 1])} + m[9]::INT) % 10 = 0",
    "hk_hkid": f"(CASE WHEN m[2] BETWEEN 'A' AND 'Z' THEN (ascii(m) - 55) * 9 + (ascii(m[2]) - 55) * 8 ELSE 324 + (ascii(m) - 55) * 8 END + {_weighted('m', [7, 6, 5, 4, 3, 2])} + CASE rtrim(m, ')')[-1] WHEN 'A' THEN 10 ELSE try_cast(rtrim(m, ')')[-1] AS INT) END) % 11 = 0",
    "jp_my_number": f"m[12]::INT = [0, 0, 9, 8, 7, 6, 5, 4, 3, 2, 1][{_weighted('m', [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2])} % 11 + 1]",
    "jp_corporate_number": "m[1]::INT = 9 - list_sum(list_transform(string_split(reverse(m[2:13]), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END * c::INT)) % 9",
    "kr_rrn": f"m[14]::INT = (11 - {_weighted('m', [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])} % 11) % 10",
    "kr_business_registration": f"({_weighted('m', [1, 3, 7, 1, 3, 7, 1, 3, 5])} + m[11]::INT * 5 // 10 + m[12]::INT) % 10 = 0",
    "in_aadhaar": f"m[1] >= '2' AND len(list_distinct(string_split(regexp_replace(m, '[^0-9]', '', 'g'), ''))) > 1 AND list_reduce(list_prepend(0, list_transform(string_split(reverse(regexp_replace(m, '[^0-9]', '', 'g')), ''), lambda c, i: {checks.TURNS}[(i - 1) % 8 + 1][c::INT + 1])), lambda a, b: {checks.PRODUCTS}[a + 1][b + 1]) = 0",
    "th_national_id": f"m[1] BETWEEN '1' AND '8' AND m[17]::INT = (11 - {_weighted('m', list(range(13, 1, -1)))} % 11) % 10",
    "cn_uscc": f"(list_sum(list_transform(string_split(m[1:17], ''), lambda c, i: (strpos('{checks.USCC_ALPHABET}', c) - 1) * {checks.USCC_WEIGHTS}[i])) + strpos('{checks.USCC_ALPHABET}', m[18]) - 1) % 31 = 0",
    "adult_age": "m::INT BETWEEN 20 AND 120",
    "value_digit": "regexp_matches(m, '[0-9]')",
    "not_all_zero": "len(replace(regexp_replace(m, '[^0-9]', '', 'g'), '0', '')) > 0",
}

LINE = "regexp_extract(substr(t, 1, s), '[^\\n]*$') || substr(t, s + 1, e - s) || regexp_extract(substr(t, e + 1), '^[^\\n]*')"


def spans(rules: list[Rule], source: str = "documents", key: str = "doc_id", text: str = "text", guarded: bool = True) -> str:
    """A query (key, rule, category, severity, score, start_char, end_char, matched_text) over a source table or CTE."""
    parts = []
    for r in rules:
        g = 1 if r.cap else 0
        p = quoted(r.expression)
        tests = [CHECKS[r.check]] if r.check else []
        if r.guard and guarded:
            tests.append(f"NOT regexp_matches({LINE}, {quoted(r.guard)})")
        if r.negated and guarded:
            tests.append(f"NOT regexp_matches(substr(t, greatest(s - {R.BACK}, 0) + 1, s - greatest(s - {R.BACK}, 0)), {quoted(R.NEGATED_BACK)})")
        where = " WHERE " + " AND ".join(f"({x})" for x in tests) if tests else ""
        parts.append(f"""SELECT k AS {key}, '{r.name}' AS rule, '{r.category}' AS category, '{r.severity}' AS severity, {SEVERITY_SCORE[r.severity]}::DOUBLE AS score,
        s::INT AS start_char, e::INT AS end_char, m AS matched_text FROM (
        SELECT k, t, m, e - length(m) AS s, e FROM (
        SELECT k, t, gs[i] AS m, list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT + list_sum(list_transform(ms[1:i], lambda x: length(x)))::BIGINT AS e FROM (
        SELECT k, t, ms, gs, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT {key} AS k, {text} AS t, regexp_extract_all({text}, {p}) AS ms, regexp_extract_all({text}, {p}, {g}) AS gs, string_split_regex({text}, {p}) AS ps
        FROM {source} WHERE regexp_matches({text}, {p})))))
        {where}""")
    return " UNION ALL ".join(parts)


def hits(source: str, phrases: list[str], key: str = "doc_id") -> str:
    """Rows (key, text, phrase, s, e) of the phrases of a lexicon in a source."""
    p = quoted(vocabulary.either(phrases))
    before = "coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT {key}, text, ms[i] AS phrase, ({before})::BIGINT AS s, s + length(ms[i]) AS e
        FROM (SELECT {key}, text, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT {key}, text, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS ps FROM {source}))"""


def fields(rules: list[Field], source: str, key: str = "doc_id") -> str:
    """A query with the columns of spans() over the values of fields."""
    parts = []
    for f in rules:
        tests = [f"({CHECKS[f.check]})"] if f.check else []
        if f.unless:
            tests.append(f"NOT regexp_matches({LINE.replace('substr(t, 1, s)', 'substr(t, 1, a)').replace('substr(t, s + 1, e - s)', 'substr(t, a + 1, b - a)').replace('substr(t, e + 1)', 'substr(t, b + 1)')}, {quoted(f.unless)})")
        where = f" AND {' AND '.join(tests)}" if tests else ""
        parts.append(f"""SELECT {key}, '{f.rule}' AS rule, 'PII' AS category, '{f.severity}' AS severity, {SEVERITY_SCORE[f.severity]}::DOUBLE AS score, (stop - length(v))::INT AS start_char, stop::INT AS end_char, v AS matched_text
        FROM (SELECT *, b + length(taken) AS stop, {"substr(t, a + 1, b - a) || taken" if f.whole else "value"} AS v, upper(value) AS m FROM (
        SELECT {key}, text AS t, s AS a, e AS b, regexp_extract(substr(text, e + 1, 200), {quoted(f.pattern() + f.end)}, 1) AS value, regexp_extract(substr(text, e + 1, 200), {quoted(f.pattern('(?:') + f.end)}) AS taken
        FROM ({hits(source, list(f.labels), key)})))
        WHERE value <> ''{where}""")
    return " UNION ALL ".join(parts)


def packs(found: Packs, source: str, key: str = "doc_id") -> str:
    """All findings of packs' fields and patterns."""
    return " UNION ALL ".join(x for x in (fields(found.fields, source, key), spans(found.patterns, source, key)) if x)


def secrets(rules: list[Secret], source: str, key: str = "doc_id") -> str:
    """A query with the columns of spans() over values near keywords; each value once."""
    entropy = CHECKS["entropy"].removesuffix(" >= 3.0").replace("(m", "(v").replace("m,", "v,")
    parts = []
    for r in rules:
        allowed = f" AND NOT regexp_matches(v, {quoted('|'.join(r.allow))})" if r.allow else ""
        varied = f" AND {entropy} >= {r.entropy}" if r.entropy > 0 else ""
        parts.append(f"""SELECT DISTINCT {key}, '{r.rule}' AS rule, 'PII' AS category, '{r.severity}' AS severity, {SEVERITY_SCORE[r.severity]}::DOUBLE AS score, (e + strpos(rest, v) - 1)::INT AS start_char,
        (e + strpos(rest, v) - 1 + length(v))::INT AS end_char, v AS matched_text
        FROM (SELECT *, regexp_extract(string_split(rest, chr(10))[1], {quoted(r.pattern)}) AS v FROM (SELECT {key}, e, substr(text, e + 1, 200) AS rest FROM ({hits(source, list(r.keywords), key)})))
        WHERE v <> ''{allowed}{varied}""")
    return " UNION ALL ".join(parts)
