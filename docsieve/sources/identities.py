"""Generated text: customers rendered as identity sheets, with national identifiers of member states of which about a third have a wrong check, and with driver's licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsieve.functions.national import DNI_LETTERS
from docsieve.sources import tables
from docsieve.sources.agreements import pick

_KEY = "CAST(c_custkey AS BIGINT)"


def _digits(size: int, salt: int) -> str:
    return f"lpad(CAST(({_KEY} * {salt * 104729} + {salt}) % {10**size} AS STRING), {size}, '0')"


def _between(low: int, high: int, salt: int) -> str:
    return f"lpad(CAST({low} + ({_KEY} * {salt * 7919} + {salt}) % 1000003 % {high - low + 1} AS STRING), 2, '0')"


_DAY = f"concat({_between(50, 99, 3)}, {_between(1, 12, 5)}, {_between(1, 28, 7)})"
#: Numbers without their checks, by country.
BODIES = {
    "b_es": _digits(8, 11), "b_nl": _digits(8, 13), "b_pl": _digits(10, 17), "b_fr": f"concat('1', {_digits(12, 19)})", "b_be": _digits(9, 23), "b_pt": f"concat({pick(3, '1', '2', '5', '4')}, {_digits(7, 29)})",
    "b_se": _digits(9, 31), "b_at": f"concat({_digits(3, 37)}, {_between(1, 30, 11)}, {_between(1, 12, 13)}, {_between(0, 99, 17)})", "b_cz": f"concat({_DAY}, {_digits(3, 41)})", "b_ro": f"concat({pick(5, '1', '2', '5', '9')}, {_DAY}, {_digits(5, 43)})",
}


def _sum(name: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"{w} * CAST(substr({name}, {k}, 1) AS INT)" for k, w in enumerate(weights, 1)) + ")"


def _wrong(salt: int) -> str:
    """0, or for about a third of the customers 1: what is added to a check."""
    return f"CASE WHEN ({_KEY} * {salt * 7919} + {salt}) % 1000003 % 3 = 0 THEN 1 ELSE 0 END"


def _check(value: str, salt: int, modulus: int = 10) -> str:
    return f"CAST(({value} + {_wrong(salt)}) % {modulus} AS STRING)"


def _two(value: str) -> str:
    return f"lpad(CAST({value} AS STRING), 2, '0')"


_LUHN = "(" + " + ".join(f"(CASE WHEN CAST(substr(b_se, {k}, 1) AS INT) > 4 THEN 2 * CAST(substr(b_se, {k}, 1) AS INT) - 9 ELSE 2 * CAST(substr(b_se, {k}, 1) AS INT) END)" if k % 2 else f"CAST(substr(b_se, {k}, 1) AS INT)" for k in range(1, 10)) + ")"
_AT = _sum("concat(substr(b_at, 1, 3), substr(b_at, 4, 6))", [3, 7, 9, 5, 8, 4, 2, 1, 6])
_PIECES = [
    pick(7, "Spanish DNI: ", "ES  NIF ", "es national id #"), "b_es", f"substr('{DNI_LETTERS}', CAST((CAST(b_es AS BIGINT) + {_wrong(3)}) % 23 AS INT) + 1, 1)", "'\n'",
    pick(11, "Dutch BSN ", "NL citizen service number="), "b_nl", _check(f"{_sum('b_nl', [9, 8, 7, 6, 5, 4, 3, 2])} % 11", 5), "', '", pick(13, "PL PESEL ", "Poland national ID: "), "b_pl", _check(f"(10 - {_sum('b_pl', [1, 3, 7, 9, 1, 3, 7, 9, 1, 3])} % 10)", 7), "'\n'",
    pick(17, "French INSEE ", "FR social security number: "), "substr(b_fr, 1, 1)", "' '", "substr(b_fr, 2)", "' '", _two(f"(97 - CAST(b_fr AS BIGINT) % 97 + {_wrong(11)})"), "'; '", pick(19, "FR NIR ", "FR wallet "), "b_fr", "'\n'",
    pick(23, "BE national number ", "Belgian rijksregisternummer: "), "substr(b_be, 1, 6)", "'.'", "substr(b_be, 7)", "'-'", _two(f"(97 - CAST(b_be AS BIGINT) % 97 + {_wrong(13)})"), "'\n'",
    pick(29, "PT NIF ", "Portuguese tax number: "), "b_pt", _check(f"(CASE WHEN {_sum('b_pt', [9, 8, 7, 6, 5, 4, 3, 2])} % 11 < 2 THEN 0 ELSE 11 - {_sum('b_pt', [9, 8, 7, 6, 5, 4, 3, 2])} % 11 END)", 17), "', SE personnummer '", "substr(b_se, 1, 6)", "'-'", "substr(b_se, 7)", _check(f"(10 - {_LUHN} % 10)", 19), "'\n'",
    "'Austrian SVNR: '", "substr(b_at, 1, 3)", _check(f"{_AT} % 11", 23), "' '", "substr(b_at, 4)", "'\n'",
    pick(31, "CZ birth number ", "Slovak birth number: ", "SK rodne cislo "), "substr(b_cz, 1, 6)", "'/'", "substr(b_cz, 7)", _check(f"(11 - CAST(b_cz AS BIGINT) * 10 % 11) % 11 % 10", 29), "'\n'",
    pick(37, "Romanian CNP ", "RO national ID "), "b_ro", _check(f"(CASE WHEN {_sum('b_ro', [2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9])} % 11 = 10 THEN 1 ELSE {_sum('b_ro', [2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9])} % 11 END)", 31), "', DK CPR '", _between(1, 31, 19), _between(1, 13, 23), _between(0, 99, 29), "'-1234\n'",
    pick(41, "German tax ID 86095742719", "DE TIN: 47036892816", "DE Steueridentifikationsnummer 65 929 970 489", "DE national ID 12345678901", "German TIN 86095742718", "DE tax ID 06095742719"), "', '",
    pick(43, "Italian tax code RSSMRA85T10A562S", "IT codice fiscale BNC LRA 72M41 F205X", "IT codice fiscale VRDGPP60A01H501R", "Italy tax code NRIPLA90E55L219F"), "'\n'",
    pick(47, "Finnish HETU 131052-308T", "FI personal identity code: 010203A1230", "FI HETU 241299+901S", "FI HETU 311102-308T", "FI HETU 131052-308U"), "', '", pick(53, "IE PPSN 1234567T", "Irish PPSN: 7654321 G", "IE PPSN 1234567FA", "IE PPSN 1234567FB", "IE PPSN 1234567U"), "'.'",
]
TEXT = f"concat({', '.join(_PIECES)})"
_BODIES = ", ".join(f"{x} AS {name}" for name, x in BODIES.items())
SQL = f"SELECT c_custkey AS doc_id, {TEXT} AS text FROM (SELECT c_custkey, {_BODIES} FROM customer)"


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): one identity sheet a customer."""
    rows = tables.table(spark, sf_dir, "customer", "c_custkey").selectExpr("c_custkey", *(f"{x} AS {name}" for name, x in BODIES.items()))
    return rows.selectExpr("c_custkey AS doc_id", TEXT.replace("\n", "\\n") + " AS text")


_LICENCE_LINES = [
    pick(3, "State: Texas. ", "issuing state = NY; ", "The issuer: Mars; ", "State of issue: North Dakota, ", "", "", "The state fair. State: Ohio. "), pick(5, "", "CA ", "New  York ", "ZZ ", "nevada "),
    pick(7, "Drivers License: ", "DL# ", "driver license number ", "Drivers licence no ", "DLN=", "licence no. "), pick(11, "A", "X", "", "AB", "ABC"), _digits(7, 47), pick(13, "", "9", "**", "-12", "XXX"), "'. '",
    pick(17, "Issued in the state of Utah.", "Issuing state: WA.", "Nothing else.", "The state: Atlantis rules."), "'\n'",
    pick(19, "D/L ", "license number: ", "FL driver license ", "DLN "), pick(23, "S", "", "12ABC", "V"), _digits(12, 53), "' - '", pick(29, "Florida", "state Florida", "issuer = VT", "issuing state: WV", ""), "'.'",
]
LICENCE_TEXT = f"concat({', '.join(_LICENCE_LINES)})"
LICENCE_SQL = f"SELECT c_custkey AS doc_id, {LICENCE_TEXT} AS text FROM customer"


def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): one sheet with licences a customer."""
    return tables.table(spark, sf_dir, "customer", "c_custkey").selectExpr("c_custkey AS doc_id", LICENCE_TEXT.replace("\n", "\\n") + " AS text")
