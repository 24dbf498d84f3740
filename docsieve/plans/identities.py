"""Queries of national identifiers and driver's licences over identity sheets, with their SQL: one expression for each lexicon, and checks with list functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import licences, national, vocabulary
from docsieve.operators import identities
from docsieve.plans import oracle
from docsieve.sources import identities as sheets


def national_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every national identifier of every sheet that passes its country's check."""
    return identities.national_ids(sheets.sheets(spark, sf_dir))


def national_id_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by country and kind of check."""
    found = identities.national_ids(sheets.sheets(spark, sf_dir))
    return found.groupBy("member_state", "validator").agg(F.count("*").alias("n_findings"), F.countDistinct("doc_id").alias("n_documents"), F.countDistinct("matched_text").alias("n_values"))


def driver_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences with their state, where the number has the state's format."""
    return identities.driver_licences(sheets.licences(spark, sf_dir))


def licence_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of licences that couldn't be checked, with the reason and its confidence."""
    found = identities.licence_fields(sheets.licences(spark, sf_dir))
    return found.where("confidence IS NOT NULL").select("doc_id", "state", "outcome", "confidence", "start_char", "matched_text")


_q = oracle.quoted


def _n(first: int, size: int, v: str = "v") -> str:
    return f"substr({v}, {first}, {size})::BIGINT"


def _sum(weights: list[int], v: str = "v") -> str:
    return f"list_sum(list_transform(list_zip(string_split({v}, '')[1:{len(weights)}], {weights}), lambda x: x[1]::INT * x[2]))"


def _day(year: str, month: str, day: str) -> str:
    return f"(try_cast(lpad(({year})::VARCHAR, 4, '0') || '-' || lpad(({month})::VARCHAR, 2, '0') || '-' || lpad(({day})::VARCHAR, 2, '0') AS DATE) IS NOT NULL)"


def _either(year: str, month: str, day: str) -> str:
    return f"({_day(f'1900 + {year}', month, day)} OR {_day(f'2000 + {year}', month, day)})"


_MONTH = f"{_n(3, 2)} - CASE WHEN {_n(3, 2)} > 70 THEN 70 WHEN {_n(3, 2)} > 50 THEN 50 WHEN {_n(3, 2)} > 20 THEN 20 ELSE 0 END"
_LUHN = "list_sum(list_transform(string_split(reverse(v[-10:]), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT < 5 THEN 2 * c::INT ELSE 2 * c::INT - 9 END)) % 10 = 0"
CHECKS = {
    "es_dni": f"v[9] = substr('{national.DNI_LETTERS}', (translate(v[1:8], 'XYZ', '012')::BIGINT % 23 + 1)::INT, 1)",
    "nl_bsn": f"{_sum([9, 8, 7, 6, 5, 4, 3, 2, -1], 'lpad(v, 9, chr(48))')} % 11 = 0",
    "pl_pesel": f"(10 - {_sum([1, 3, 7, 9, 1, 3, 7, 9, 1, 3])} % 10) % 10 = v[11]::INT",
    "fr_nir": f"length(v) = 13 OR (({_n(1, 13)} + try_cast(v[14:15] AS BIGINT)) % 97 = 0 AND v[14:15] BETWEEN '01' AND '97')",
    "de_tax_id": "v[1] <> '0' AND (11 - list_reduce(list_prepend(10, list_transform(string_split(v[1:10], ''), lambda c: c::INT)), lambda p, d: 2 * CASE (p + d) % 10 WHEN 0 THEN 10 ELSE (p + d) % 10 END % 11)) % 10 = v[11]::INT",
    "it_codice": f"ascii(v[16]) - 65 = list_sum(list_transform(string_split(v[1:15], ''), lambda c, i: CASE WHEN i % 2 = 1 THEN {national.CODICE_ODD}[coalesce(try_cast(c AS INT), ascii(c) - 65) + 1] ELSE coalesce(try_cast(c AS INT), ascii(c) - 65) END)) % 26",
    "be_national": f"{_n(10, 2)} IN (97 - {_n(1, 9)} % 97, 97 - ('2' || v[1:9])::BIGINT % 97)",
    "pt_nif": f"v[1] IN ('1', '2', '3', '5', '6', '8', '9') AND CASE WHEN 11 - {_sum([9, 8, 7, 6, 5, 4, 3, 2])} % 11 >= 10 THEN 0 ELSE 11 - {_sum([9, 8, 7, 6, 5, 4, 3, 2])} % 11 END = v[9]::INT",
    "se_personnummer": _LUHN.replace("v[-10:]", "regexp_replace(v, '[^0-9]', '', 'g')[-10:]"),
    "fi_hetu": f"{_day('CASE v[7] WHEN chr(43) THEN 1800 WHEN chr(65) THEN 2000 ELSE 1900 END + v[5:6]::INT', 'v[3:4]', 'v[1:2]')} AND v[11] = substr('{national.HETU_LETTERS}', ((v[1:6] || v[8:10])::BIGINT % 31 + 1)::INT, 1)",
    "ie_ppsn": f"v[8] = substr('{national.PPSN_LETTERS}', (({_sum([8, 7, 6, 5, 4, 3, 2])} + CASE WHEN length(v) = 9 THEN 9 * (ascii(v[9]) - 64) ELSE 0 END) % 23 + 1)::INT, 1)",
    "at_svnr": f"{_sum([3, 7, 9, 5, 8, 4, 2, 1, 6], '(v[1:3] || v[5:10])')} % 11 = v[4]::INT AND {_either('v[9:10]::INT', 'v[7:8]', 'v[5:6]')}",
    "dk_cpr": _either("v[5:6]::INT", "v[3:4]", "v[1:2]"),
    "cz_birth": f"v::BIGINT % 11 = 0 AND {_either('v[1:2]::INT', _MONTH, 'v[5:6]')}",
    "ro_cnp": f"v[1] BETWEEN '1' AND '8' AND {_day('[1900, 1900, 1800, 1800, 2000, 2000, 1900, 1900][CASE WHEN v[1] BETWEEN chr(49) AND chr(56) THEN v[1]::INT ELSE 1 END] + v[2:3]::INT', 'v[4:5]', 'v[6:7]')} AND CASE {_sum([2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9])} % 11 WHEN 10 THEN 1 ELSE {_sum([2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9])} % 11 END = v[13]::INT",
}


def _national() -> str:
    rows, first = [], set()
    for name, country, checked in national.fields():
        if vocabulary.normal(name) not in first:
            first.add(vocabulary.normal(name))
            rows.append(f"({_q(vocabulary.normal(name))}, '{country}', {checked})")
    parts = " UNION ALL ".join(
        f"""SELECT doc_id, member_state, checked, e + length(regexp_extract(tail, {_q(f'{national.SIGN}(?:{c.shape})')})) AS stop, regexp_extract(tail, {_q(rf'{national.SIGN}({c.shape})' + chr(92) + 'b')}, 1) AS m, '{c.check}' AS name
        FROM f WHERE member_state = '{c.code}'"""
        for c in national.COUNTRIES
    )
    checks = " ".join(f"WHEN '{name}' THEN ({sql})" for name, sql in CHECKS.items())
    return f"""
sheets AS ({sheets.SQL}),
lexicon(phrase, member_state, checked) AS (VALUES {', '.join(rows)}),
f AS (
  SELECT doc_id, l.member_state, l.checked, e, substr(text, e + 1, 80) AS tail FROM ({oracle.hits('sheets', [name for name, *_ in national.fields()])}) h
  JOIN lexicon l ON l.phrase = lower(regexp_replace(h.phrase, '\\s+', ' ', 'g'))),
values_found AS (SELECT *, CASE name WHEN 'fi_hetu' THEN m ELSE upper(regexp_replace(m, '[ ./-]', '', 'g')) END AS v FROM ({parts}) WHERE m <> ''),
found AS (
  SELECT doc_id, 'eu_national_id' AS rule, member_state, CASE WHEN NOT checked THEN 'label' WHEN member_state = 'DK' THEN 'date_shape' ELSE 'checksum' END AS validator,
    (stop - length(m))::INT AS start_char, stop::INT AS end_char, m AS matched_text
  FROM values_found WHERE NOT checked OR CASE name {checks} END)"""


def _licences() -> str:
    states = ", ".join(f"('{code}', '{name.upper()}', {_q(shape)})" for code, name, shape in licences.STATES)
    told = lambda x: f"list_transform(regexp_extract_all({x}, {_q(licences.TOLD)}, 1), lambda y: upper(regexp_replace(y, '\\s+', ' ', 'g')))"
    return f"""
sheets AS ({sheets.LICENCE_SQL}),
states(code, name, shape) AS (VALUES {states}),
known AS (SELECT map(list(k), list(code)) AS codes FROM (SELECT code AS k, code FROM states UNION ALL SELECT name, code FROM states)),
h AS (
  SELECT doc_id, e, text, substr(text, greatest(s - {licences.REACH}, 0) + 1, s - greatest(s - {licences.REACH}, 0)) AS lft, substr(text, e + 1, {licences.REACH + 40}) AS rgt FROM ({oracle.hits('sheets', licences.LABELS)})),
n AS (
  SELECT *, regexp_extract(rgt, {_q(f'{licences.SIGN}({licences.NUMBER}){licences.BEHIND}')}, 1) AS number, length(regexp_extract(rgt, {_q(f'{licences.SIGN}{licences.NUMBER}')})) AS stop FROM h),
w AS (
  SELECT *, upper(regexp_replace(regexp_extract(lft, {_q(licences.BEFORE)}, 1), '\\s+', ' ', 'g')) AS before, {told(f"lft || ' . ' || substr(rgt, stop + 1, {licences.REACH})")} AS told,
    nullif(regexp_extract(right(lft, {licences.SHORT_REACH}), {_q(licences.CAPITALS)}, 1), '') AS capitals, {told(f"right(lft, {licences.SHORT_REACH}) || ' . ' || substr(rgt, stop + 1, {licences.SHORT_REACH})")}[1] AS near
  FROM n WHERE number <> ''),
s AS (
  SELECT *, coalesce(codes[before], list_filter(list_transform(told, lambda y: coalesce(codes[y], codes[string_split(y, ' ')[1]])), lambda y: y IS NOT NULL)[1]) AS state, coalesce(capitals, near) AS other,
    regexp_matches(regexp_replace(number, '[\\s-]', '', 'g'), {_q(licences.MASKED)}) AS masked, upper(regexp_replace(number, '[\\s-]', '', 'g')) AS plain
  FROM w, known),
found AS (
  SELECT doc_id, s.state, (e + stop)::INT AS end_char, number,
    CASE WHEN s.state IS NOT NULL THEN CASE WHEN masked THEN 'masked' WHEN regexp_full_match(plain, shape) THEN 'valid' ELSE 'invalid' END
      WHEN other IN (SELECT code FROM states) THEN CASE WHEN masked THEN 'masked' ELSE 'missing_state' END
      WHEN other IS NOT NULL THEN 'unsupported_state' ELSE 'missing_state' END AS outcome
  FROM s LEFT JOIN states t ON t.code = s.state)"""


_WARN = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in licences.WARNINGS.items())
QUERIES = {f.__name__: f for f in (national_ids, national_id_rates, driver_licences, licence_warnings)}
ORACLE_SQL = {
    "national_ids": f"WITH {_national()} SELECT * FROM found",
    "national_id_rates": f"WITH {_national()} SELECT member_state, validator, count(*) AS n_findings, count(DISTINCT doc_id) AS n_documents, count(DISTINCT matched_text) AS n_values FROM found GROUP BY ALL",
    "driver_licences": f"WITH {_licences()} SELECT doc_id, 'us_driver_license' AS rule, state, (end_char - length(number))::INT AS start_char, end_char, number AS matched_text FROM found WHERE outcome = 'valid'",
    "licence_warnings": f"WITH {_licences()} SELECT doc_id, state, outcome, CASE outcome {_WARN} END AS confidence, (end_char - length(number))::INT AS start_char, number AS matched_text FROM found WHERE outcome NOT IN ('valid', 'invalid')",
}
