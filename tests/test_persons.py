"""Persons and defined terms against a search pattern by pattern, and on awkward texts."""

import random
import re
import time

import pytest

from docsieve.operators import persons

SCHEMA = "doc_id long, text string, document_type string, person string, how string, n int"
NAME = re.compile(r"\b(?i:Mr|Ms|Mrs|Mdm|Dr|Prof)\.?[ \t]+[A-Z][a-z]+(?:-[A-Z][a-z]+)?(?:[ \t]+(?:(?i:bin|binti|s/o|d/o|a/l|a/p|al)[ \t]+)?[A-Z][a-z]+(?:-[A-Z][a-z]+)?){0,5}\b")


def _brute(text, terms):
    """Mentions by one search of the text for each name: (start, end, how)."""
    out, first = [], {}
    free = lambda s, e: all(e <= a or b <= s for a, b, _ in out)
    bare = lambda x: re.sub(r"(?i)^(mr|ms|mrs|mdm|dr|prof|sir|dame)\.?\s+", "", x).strip()
    for m in NAME.finditer(text):
        if bare(m[0]).lower() not in terms:
            out.append((*m.span(), "honorific"))
            first.setdefault(re.sub(r"[\s.,&]+", " ", bare(m[0])).strip().lower(), bare(m[0]))
    wanted = [(x, "name") for x in first.values() if len(x) >= 3]
    seen = set()
    for x in first.values():
        last = x.split()[-1]
        if len(x.split()) > 1 and last[0].isupper() and last.lower() not in {*seen, *persons.COMPANY_WORDS, *terms}:
            seen.add(last.lower())
            wanted.append((last, "surname"))
    for word, how in wanted:
        for m in re.finditer(rf"\b{re.escape(word)}\b", text):
            if free(*m.span()) and word.lower() not in terms:
                out.append((*m.span(), how))
    return sorted(out)


def test_mentions_equal_a_search_for_each_name(spark):
    rng = random.Random(2)
    words = ["Jane", "Tan", "Wei", "Lee", "Li", "Ltd", "Mei-Ling", "Kumar", "Tanner", "tan", "and", "Dr", "Mr.", "Prof", "bin", "met", ",", "\n", "Vendor", '(the "Vendor")', "Group"]
    texts = ["".join(w + rng.choice([" ", " ", " ", "  ", ""]) for w in rng.choices(words, k=rng.randrange(5, 60))) for _ in range(300)]
    out = {}
    for r in persons.linked(spark.createDataFrame([(k, t, "memo", "x", "y", 1) for k, t in enumerate(texts)], SCHEMA).repartition(4)).collect():
        assert texts[r["doc_id"]][r["start_char"] : r["end_char"]] == r["matched_text"]
        out.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"], r["how"]))
    for k, text in enumerate(texts):
        terms = {"vendor"} if re.search(r'\(\s*(?:the\s+)?"Vendor"\s*\)', text) else set()
        assert sorted(out.get(k, [])) == _brute(text, terms), text


@pytest.mark.parametrize(
    "text, term",
    [
        ('Omar Pte Ltd (the "Purchaser")', ["purchaser"]), ("(“Vendor”) sells", ["vendor"]), ('(collectively, the "Sellers")', ["sellers"]), ('"Long Stop Date" shall mean May', ["long stop date"]),
        ('"Company," has the meaning below', ["company"]), ('this "Deed" is dated', ["deed"]), ("term sheet (TS)", ["ts"]), ("the shareholders' agreement (SHA)", ["sha"]),
        ('the "purchaser" is here', []), ('a "Thing" was seen', []), ("memorandum (MOU)", []), (None, []), ("", []),
    ],
)
def test_defined_terms(spark, text, term):
    row = spark.createDataFrame([(text,)], "text string").select(persons.defined_terms("text").alias("x")).first()
    assert (row["x"] or []) == term


def test_terms_suppress_and_severity_follows_the_type(spark):
    text = 'Mr Vendor and Dr Jane Tan (the "Vendor"), then Vendor, Jane Tan, Tan'
    docs = spark.createDataFrame([(1, text, "SPA ", "x", "y", 1), (2, text, None, "x", "y", 1), (3, None, "spa", "x", "y", 1), (4, "", "spa", "x", "y", 1), (1, text, "SPA ", "x", "y", 1), (None, "Ms Wu", "chat", "x", "y", 1)], SCHEMA)
    found = persons.linked(docs).collect()
    assert sorted((r["doc_id"] or 0, r["severity"], r["matched_text"], r["how"]) for r in found) == sorted(
        2 * [(1, "high", "Dr Jane Tan", "honorific"), (1, "high", "Jane Tan", "name"), (1, "high", "Tan", "surname")]
        + [(2, "low", "Dr Jane Tan", "honorific"), (2, "low", "Jane Tan", "name"), (2, "low", "Tan", "surname"), (0, "low", "Ms Wu", "honorific")]
    )
    assert {r["person"] for r in found} == {"jane tan", "wu"}
    assert persons.linked(docs.where("false")).collect() == []
    kept = persons.suppressed(spark.createDataFrame([(1, "Mr Vendor"), (1, "VENDOR"), (1, "Jane"), (9, "Vendor")], "doc_id long, matched_text string"), docs.where("doc_id = 2").withColumn("doc_id", docs["doc_id"] - 1))
    assert sorted(map(tuple, kept.collect())) == [(1, "Jane"), (9, "Vendor")]


def test_many_names_in_one_text_take_one_reading():
    """20,000 names of one document, each mentioned again: minutes if every name searched the text."""
    letters = "abcdefghij"
    name = lambda k: "N" + "".join(letters[int(c)] for c in f"{k:05d}")
    names, at = [], 0
    for k in range(20_000):
        m = f"Mr {name(k)} Foo{name(k)[1:]}"
        names.append({"start_char": at, "end_char": at + len(m), "matched_text": m, "bare": m[3:], "person": m[3:].lower()})
        at += len(m) + 1
    text = " ".join([*(n["matched_text"] for n in names), *(n["bare"] for n in names)])
    began = time.time()
    out = persons._linked(text, names, set())
    assert len(out) == 40_000 and time.time() - began < 20
