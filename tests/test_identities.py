"""Lexicons, national identifiers and driver's licences: against plain searches, planted truth, and single numbers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docsieve.functions import licences, national, vocabulary
from docsieve.operators import identities, keywords
from docsieve.plans import identities as plans
from docsieve.sources import identities as sheets

SCHEMA = "doc_id long, text string, phrase int, state string, right string, plain string"


def test_lexicon_equals_one_expression(spark):
    """The automaton against the expression that SQL uses, over texts of phrases run together and apart."""
    rng = random.Random(5)
    phrases = ["DL#", "D/L", "license no", "license no.", "License  Number", "no", "state", "state of issue", "issue", "licence", "ab", "ab cd", "b c", "a", ""]
    pieces = ["dl#", "D/L", "license", "NO.", "no", "number", "state", "of", "issue", "ab", "cd", "éa", "_", "é", "9", "."]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "  ", "\n", "", "\t \n"]) for _ in range(rng.randrange(30))) for _ in range(500)]
    found = keywords.automaton(phrases)
    for text in texts:
        flat = [(m.start(), m.end()) for m in re.finditer(vocabulary.either(phrases), text)]
        assert [(s, e) for _, s, e in keywords.search(found, text)] == flat, text
        assert all(vocabulary.normal(text[s:e]) == vocabulary.normal(phrases[k]) for k, s, e in keywords.search(found, text))


def test_hits(spark):
    docs = spark.createDataFrame([(1, "the STATE  of issue is here", 0, "", "", ""), (None, None, 0, "", "", ""), (2, "", 0, "", "", ""), (1, "the STATE  of issue is here", 0, "", "", "")], SCHEMA)
    rows = [tuple(r) for r in keywords.hits(docs, ["state of issue", "here"], 4, 3).collect()]
    assert sorted(rows) == [(1, 0, 4, 19, "the ", " is"), (1, 0, 4, 19, "the ", " is"), (1, 1, 23, 27, " is ", ""), (1, 1, 23, 27, " is ", "")]
    assert keywords.hits(docs, []).collect() == [] and keywords.hits(docs.where("false"), ["x"]).collect() == []
    with pytest.raises(ValueError):
        keywords.hits(docs, ["x" * (keywords.MOST_CHARS + 1)])


NUMBERS = {
    "ES": (["12345678Z", "X1234567L", "Z1234567R"], ["12345678A", "X1234567A", "00000000A"]),
    "NL": (["111222333", "123456782", "10000008"], ["111222334", "123456789"]),
    "PL": (["44051401359", "02070803628"], ["44051401358"]),
    "FR": (["255081416802538", "2550814168025", "2 55 08 14 168 025 38"], ["255081416802539", "255081416802500"]),
    "DE": (["86095742719", "47036892816", "65 929 970 489"], ["86095742718", "06095742719"]),
    "IT": (["RSSMRA85T10A562S", "BNCLRA72M41F205X"], ["RSSMRA85T10A562T"]),
    "BE": (["93.05.18-223.61", "00010100105"], ["93051822362"]),
    "PT": (["123456789", "501442600"], ["123456788", "423456789"]),
    "SE": (["811228-9874", "198112289874"], ["811228-9873"]),
    "FI": (["131052-308T", "010203A1230"], ["131052-308U", "310252-308T", "131052A308U"]),
    "IE": (["1234567T", "1234567FA"], ["1234567U", "1234567FB"]),
    "AT": (["1237010180", "1237 010180"], ["1238010180", "1237320180"]),
    "DK": (["010190-1234", "311299 0000"], ["320190-1234", "011390-1234"]),
    "CZ": (["736028/5163"], ["736028/5164", "730028/5160"]),
    "SK": (["7360285163"], ["7360285164"]),
    "RO": (["1800101221144"], ["1800101221145", "9800101221144", "1801301221144"]),
}


def test_checks_of_all_countries(spark):
    rows = [(code, v, k == 0) for code, both in NUMBERS.items() for k, values in enumerate(both) for v in values]
    table = spark.createDataFrame(rows, "code string, v string, expected boolean")
    wrong = table.withColumn("found", national.valid(F.col("code"), F.col("v"))).where("found <> expected").collect()
    assert wrong == [] and set(NUMBERS) == {c.code for c in national.COUNTRIES}


def test_fields_in_text(spark):
    text = "DE national ID 12345678901; German TIN 86095742719, ES DNI: 12345678-Z. es dni 12345678A, PT NIF 123456789\nDK CPR 010190-1234 FR wallet 255081416802538, PL PESEL 440514013590"
    docs = spark.createDataFrame([(7, text, 0, "", "", ""), (8, None, 0, "", "", "")], SCHEMA)
    found = [(r["member_state"], r["validator"], r["matched_text"], text[r["start_char"] : r["end_char"]]) for r in identities.national_ids(docs).orderBy("start_char").collect()]
    assert found == [(c, v, m, m) for c, v, m in (("DE", "label", "12345678901"), ("DE", "checksum", "86095742719"), ("ES", "checksum", "12345678-Z"), ("PT", "checksum", "123456789"), ("DK", "date_shape", "010190-1234"))]


def test_planted_numbers(spark, sf_dir):
    """Sheets with right and wrong checks: found are exactly the right ones of the countries whose check always changes when it is altered."""
    salts = {"ES": 3, "FR": 11, "BE": 13, "PL": 7, "SE": 19}
    keys = [r["c_custkey"] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").collect()]
    planted = {(k, c) for k in keys for c, s in salts.items() if (k * s * 7919 + s) % 1000003 % 3}
    checked = plans.national_ids(spark, sf_dir).where("validator = 'checksum'").collect()
    found = {(r["doc_id"], r["member_state"]) for r in checked if len(re.sub("[^0-9]", "", r["matched_text"])) != 13}
    assert {x for x in found if x[1] in salts} == planted
    assert {r["member_state"] for r in checked} | {"DK"} >= set(NUMBERS) - {"SK"}


@pytest.mark.parametrize(
    "text, state, outcome, number",
    [
        ("CA driver's license: A1234567.", "CA", "valid", "A1234567"), ("New  York DL# 123456789", "NY", "valid", "123456789"), ("driver license number 1234567, issuing state: Texas", "TX", "valid", "1234567"),
        ("State: Ohio. DLN=AB123456", "OH", "valid", "AB123456"), ("state fair; issuer = VT; D/L 1234567a", "VT", "valid", "1234567a"), ("CA driver's license 1234567", "CA", "invalid", "1234567"),
        ("CA driver's license A12**567", "CA", "masked", "A12**567"), ("ZZ license no. 1234567", None, "unsupported_state", "1234567"), ("issuer: Mars, DL# 1234567", None, "unsupported_state", "1234567"),
        ("license number 1234567 of him", None, "missing_state", "1234567"), ("state: Texas." + "." * 95 + "DLN 1234567", None, "missing_state", "1234567"), ("NV DLN X12345678", "NV", "valid", "X12345678"),
    ],
)
def test_licences(spark, text, state, outcome, number):
    rows = identities.licence_fields(spark.createDataFrame([(1, text, 0, "q", "", "")], SCHEMA)).collect()
    assert [(r["state"], r["outcome"], r["matched_text"], text[r["start_char"] : r["end_char"]]) for r in rows] == [(state, outcome, number, number)]
    assert rows[0]["confidence"] == licences.WARNINGS.get(outcome)


def test_every_state_has_a_format():
    assert len({code for code, *_ in licences.STATES}) == 50 and all(re.compile(shape) for *_, shape in licences.STATES)
    assert sheets.LICENCE_SQL and identities.national_ids
