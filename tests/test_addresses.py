"""Addresses phase by phase against a plain reading of each text, and on single cases."""

import random
import re

import pytest

from docsieve.functions import places
from docsieve.operators import addresses

SCHEMA = "doc_id long, text string, rule string, phase string, c int, size int"


def _substance(x):
    postcode, locality = re.search(places.POSTCODE, x), re.search(places.LOCALITY, x)
    words = re.search(places.WORDS_OF_ADDRESS, x)
    return bool(re.search("[0-9]", x) and ((words and (postcode or locality or re.search(places.REGION, x))) or (postcode and locality)))


def _office(x):
    return bool(re.search(places.ORGANISATION, x) and not re.search(places.PERSON_LINKED, x))


def _field(line):
    return bool(re.match(r"\s*[A-Za-z][A-Za-z ]{0,40}\s*[:：]", line))


def _trim(text, s, e):
    while s < e and text[s] in " \t\r\n":
        s += 1
    while s < e and text[e - 1] in " \t\r\n.;":
        e -= 1
    return s, e


def _extended(text, e, fits):
    """The end after up to two more lines."""
    for _ in range(2):
        m = re.compile(r"\n([^\n]*)").match(text, e)
        if not m or not fits(m[1]) or _field(m[1]):
            break
        e += 1 + (min(len(m[1]), 160) if fits("x" * 6) and not fits("x") else len(m[1]))
    return e


def _brute(text, shapes):
    out = []
    overlaps = lambda s, e: any(s < b and a < e for *_, a, b in out)
    line = lambda s, e: text[text.rfind("\n", 0, s) + 1 : (text + "\n").index("\n", e)]
    for shape in [x for x in shapes if not x.late]:
        out += [(shape.rule, "country", *m.span()) for m in re.finditer(shape.pattern, text) if not _office(line(*m.span()))]
    first = len(out)
    for m in re.finditer(places.LABELLED, text):
        s, e = _trim(text, m.start(1), _extended(text, m.end(1), lambda x: len(x) >= 6))
        if s < e and not overlaps(s, e) and _substance(text[s:e]):
            out.append(("postal_address", "labelled", s, e))
    for m in re.finditer(places.FREEFORM, text):
        s, e = _trim(text, *m.span(1))
        if s < e and not overlaps(s, e) and _substance(text[s:e]) and not _office(text[s:e]):
            out.append(("postal_address", "person", s, e))
    at = 0
    for raw in text.split("\n"):
        end = at + len(raw)
        if raw.strip(" \t\r") and re.search(places.PERSON_LINKED, raw):
            s, e = _trim(text, at, _extended(text, end, lambda x: bool(x.strip(" \t\r"))))
            value = text[s:e]
            head, _, tail = value.partition("\n")
            begin, stop = s, e
            if not _substance(head):
                a, b = _trim(text, e - len(tail), e)
                if _substance(text[a:b]):
                    begin, stop = a, b
            value = text[begin:stop]
            if s < e and not overlaps(s, e) and ("\n" not in value or re.search("[0-9]", value.partition("\n")[2])) and not _office(value) and _substance(value):
                out.append(("postal_address", "lines", begin, stop))
        at = end + 1
    for shape in [x for x in shapes if x.late]:
        for m in re.finditer(shape.pattern, text):
            if not overlaps(*m.span()) and not _office(line(*m.span())):
                out.append((shape.rule, "late", *m.span()))
    assert first <= len(out)
    return sorted(out)


def test_phases_equal_a_plain_reading(spark):
    rng = random.Random(7)
    parts = [
        "12 Maple Street, London SW1A 1AA", "5 Oak Avenue, Boston MA 02108", "Home address: ", "Mailing Address:", "Attn: ", "Dr Jane Tan, ", "the patient", "registered office ", "head office ", "c/o ", "7 Jalan Ampang, 50450 Kuala Lumpur",
        "Block 12, Singapore 569933", "Tokyo 100-0001", "Marina Way", "Phone: 5551234", "9 Rizal Street, Cebu 6000", "3 Nehru Marg, 110001 Delhi", "Jl. Sudirman No. 52, Jakarta 12190", "words only", "400 Fifth Avenue, New York 10001",
    ]
    texts = ["".join(rng.choice(parts) + rng.choice(["\n", "\n", ", ", " ", "; ", ".\n\n", " \r\n"]) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    docs = spark.createDataFrame([(k, t, "r", "p", 1, 2) for k, t in enumerate(texts)], SCHEMA).repartition(4)
    for packs in (None, ["UK", "MY"]):
        shapes = [s for s in places.SHAPES if packs is None or s.pack in packs]
        out = {k: [] for k in range(len(texts))}
        for r in addresses.find(docs, packs).collect():
            assert texts[r["doc_id"]][r["start_char"] : r["end_char"]] == r["matched_text"]
            out[r["doc_id"]].append((r["rule"], r["phase"], r["start_char"], r["end_char"]))
        expected = {k: _brute(t, shapes) for k, t in enumerate(texts)}
        assert {k: sorted(v) for k, v in out.items()} == expected
        assert {x[1] for v in expected.values() for x in v} == set(addresses.PHASES)


@pytest.mark.parametrize(
    "text, found",
    [
        ("12 Maple Street, London SW1A 1AA", [("uk_postal_address", "country", "12 Maple Street, London SW1A 1AA")]),
        ("Registered office: 12 Maple Street, London SW1A 1AA", []),
        ("The client's registered office: 12 Maple Street, London SW1A 1AA", [("uk_postal_address", "country", "12 Maple Street, London SW1A 1AA")]),
        ("Home address: Block 12 #03-04,\nOrchard Road\nSingapore 238801\nmore", [("postal_address", "labelled", "Block 12 #03-04,\nOrchard Road\nSingapore 238801")]),
        ("Home address: Block 12 #03-04,\nTel: 1234567\nSingapore 238801", []),
        ("Home address: nothing at all of that kind", []),
        ("Attn: the desk\n7 Marina Way\nDubai 500001", [("postal_address", "lines", "7 Marina Way\nDubai 500001")]),
        ("The weather\n7 Marina Way\nDubai 500001", []),
        ("350 King Street, Riyadh 12345", [("sa_postal_address", "late", "350 King Street, Riyadh 12345")]),
        ("Address: 350 King Street, Riyadh 12345.", [("postal_address", "labelled", "350 King Street, Riyadh 12345")]),
        ("〒100-0001 東京都千代田区1-1", [("jp_postal_address", "country", "〒100-0001 東京都千代田区1-1")]),
        ("Jane Tan, 5 Hill Road, Sydney; and so on", [("postal_address", "person", "5 Hill Road, Sydney")]),
        ("", []), (None, []), ("no digit here", []),
    ],
)
def test_cases(spark, text, found):
    rows = addresses.find(spark.createDataFrame([(None, text, "r", "p", 1, 2)], SCHEMA)).collect()
    assert [(r["rule"], r["phase"], r["matched_text"]) for r in rows] == found


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "350 King Street, Riyadh 12345", "r", "p", 1, 2)] * 2, SCHEMA)
    assert addresses.find(docs).count() == 2
    assert addresses.find(docs.where("false")).collect() == []
    assert addresses.find(docs, []).collect() == []
