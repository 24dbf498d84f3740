"""Minors: single cases of ages, grades, phrases and guards, and cliffs of several jurisdictions."""

import pytest
from pyspark.sql import functions as F

from docsieve.functions import ages
from docsieve.operators import minors

SCHEMA = "doc_id long, text string, packs array<string>, age int, severity string"
CASES = [
    ("aged 12, alone", ["US"], [("high", 12, "US", "aged 12")]),
    ("aged 13", ["US"], []),
    ("aged 13", ["US", "EU"], [("medium", 13, "EU", "aged 13")]),
    ("aged 12", ["US", "EU"], [("high", 12, "EU+US", "aged 12")]),
    ("a 15-year-old and a 26 year old", ["IN"], [("high", 15, "IN", "15-year-old")]),
    ("aged 18 of experience, 17 years old+", ["IN"], []),
    ("children under 12 years of age; under 12 bridges", ["CN"], [("high", 12, "CN", "under 12 years of age")]),
    ("Primary 6, secondary 1", ["CN"], [("high", 12, "CN", "Primary 6"), ("high", 13, "CN", "secondary 1")]),
    ("Year 9 student, Year 2 of the contract", ["EU"], [("high", 13, "EU", "Year 9 student")]),
    ("3rd grade, tier 3rd grade", ["SG"], [("high", 8, "SG", "3rd grade")]),
    ("parental  consent was given for a child's data", ["US", "CN"], [("high", None, "CN+US", "parental  consent"), ("high", None, "CN+US", "child's data")]),
    ("child labour law and minor repairs", ["US"], []),
    ("aged 17", ["XX"], [("high", 17, "SG", "aged 17")]),
    ("aged 17", None, [("high", 17, "SG", "aged 17")]),
    (None, ["SG"], []),
    ("", [], []),
]


def test_cases(spark):
    docs = spark.createDataFrame([(k, t, p, 1, "x") for k, (t, p, _) in enumerate(CASES)], SCHEMA).repartition(3)
    out = {}
    for r in minors.find(docs, F.coalesce("packs", F.expr("cast(array() AS array<string>)"))).orderBy("start_char").collect():
        out.setdefault(r["doc_id"], []).append((r["severity"], r["age"], r["triggered"], r["matched_text"]))
    assert out == {k: found for k, (*_, found) in enumerate(CASES) if found}
    assert minors.find(docs.where("false"), F.col("packs")).collect() == []


@pytest.mark.parametrize("code, cliff", sorted(ages.CLIFFS.items()))
def test_every_cliff_is_the_first_age_that_is_free(spark, code, cliff):
    docs = spark.createDataFrame([(1, f"aged {cliff - 1}, aged {cliff}", [code], 1, "x")], SCHEMA)
    assert [(r["age"], r["triggered"]) for r in minors.find(docs, F.col("packs")).collect()] == [(cliff - 1, code)]
