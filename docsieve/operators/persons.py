"""Persons of a document, linked: names behind an honorific, the same names without one, and their surnames alone, less what the document defines as a term.

A document's own names are searched in its own text. They make one automaton, so a text is read once however many names it holds. Three passes take
places in turn, each leaving what an earlier one has taken: names with an honorific, whole names, surnames of names with two parts or more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.operators import spans

# Titles, particles within names, words that end a company's name, and document types in which a person's name weighs more.
HONORIFICS = ["Mr", "Ms", "Mrs", "Mdm", "Dr", "Prof"]
KNIGHTHOODS = ["Sir", "Dame"]
PARTICLES = ["bin", "binti", "s/o", "d/o", "a/l", "a/p", "al"]
COMPANY_WORDS = [
    "ltd", "limited", "inc", "incorporated", "llc", "llp", "plc", "corp", "corporation", "co", "company", "gmbh", "ag", "sa", "nv", "bv", "pte", "pvt", "sdn", "bhd",
    "holdings", "industries", "ventures", "capital", "partners", "group",
]
WEIGHTY_TYPES = ["spa", "nda", "sha", "term_sheet", "shareholders_agreement"]
# How a contract brings in a term.
DETERMINERS = ["the", "this", "that", "these", "those"]
MEANS = ["means", "shall mean", "has the meaning", "refers to", "will mean"]
IS = ["is", "shall be", "will be", "refers to", "means"]
AGREEMENTS = ["share purchase agreement", "shareholder agreement", "shareholders agreement", "shareholders' agreement", "shareholders’ agreement", "asset purchase agreement", "memorandum of understanding", "letter of intent", "term sheet"]

#: Least letters of a whole name, and of a surname, that are looked for.
LEAST_NAME, LEAST_SURNAME = 3, 2


def _either(words: list[str]) -> str:
    """Any of the words or phrases, in either case."""
    return "(?i:" + "|".join(r"\s+".join(map(re.escape, w.split())) for w in words) + ")"


_PART = "[A-Z][a-z]+(?:[-‐-―][A-Z][a-z]+)?"
#: A name behind an honorific.
NAME = rf"\b{_either(HONORIFICS)}\.?[ \t]+{_PART}(?:[ \t]+(?:{_either(PARTICLES)}[ \t]+)?{_PART}){{0,5}}\b"
_TERM = r"[\"“‘]([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*)[,.;:]?[\"”’]"
#: The ways to define a term; group 1 is the term.
DEFINITIONS = [
    rf"\(\s*(?:{_either(DETERMINERS)}\s+|(?i:collectively),?\s+(?:(?i:the)\s+)?)?{_TERM}\s*\)",
    rf"{_TERM}\s+{_either(MEANS)}",
    rf"\b{_either(DETERMINERS)}\s+{_TERM}\s+{_either(IS)}",
    rf"\b{_either(AGREEMENTS)}\s*\(([A-Z]{{2,5}})\)",
]
_HONORIFIC = rf"(?i)^(?:{'|'.join(HONORIFICS + KNIGHTHOODS)})\.?\s+"


def stripped(name: Column) -> Column:
    """A name without its honorific."""
    return F.trim(F.regexp_replace(name, _HONORIFIC, ""))


def canonical(name: Column) -> Column:
    """What all forms of one name share: no honorific, one blank for any run of blanks and points, lower case."""
    return F.lower(F.trim(F.regexp_replace(stripped(name), r"[\s.,&]+", " ")))


def defined_terms(text: str) -> Column:
    """The terms that a text column, given by name, defines, in lower case."""
    found = ", ".join(f"regexp_extract_all(`{text}`, {spans.quoted(p)}, 1)" for p in DEFINITIONS)
    return F.expr(f"array_distinct(transform(concat({found}), x -> lower(trim(x))))")


def undefined(name: Column, terms: Column) -> Column:
    """Whether a found name is none of its document's terms, with or without its honorific."""
    return ~F.array_contains(terms, F.lower(stripped(name)))


def _words(text: str, start: int, end: int) -> bool:
    """Whether a match stands between ends of words."""
    inside = lambda c: c.isalnum() or c == "_"
    return not (start and inside(text[start - 1])) and not (end < len(text) and inside(text[end]))


def _linked(text: str, names: list[dict], terms: set[str]) -> list[tuple[int, int, str, str, str]]:
    """(start, end, text, how, person) of each finding of one document, in order of the passes; names have start_char, end_char, matched_text, bare and person."""
    if not names:
        return []
    taken, out, first = bytearray(len(text)), [], {}
    for n in names:
        taken[n["start_char"] : n["end_char"]] = b"\x01" * (n["end_char"] - n["start_char"])
        out.append((n["start_char"], n["end_char"], n["matched_text"], "honorific", n["person"]))
        first.setdefault(n["person"], n["bare"])
    wanted: list[tuple[str, str, str]] = [(bare, "name", person) for person, bare in first.items() if len(bare) >= LEAST_NAME]
    surnames = set()
    for person, bare in first.items():
        last = bare.split()[-1] if len(bare.split()) > 1 else ""
        low = last.lower()
        if len(last) >= LEAST_SURNAME and last[0].isupper() and low not in surnames and low not in COMPANY_WORDS and low not in terms:
            surnames.add(low)
            wanted.append((last, "surname", person))
    own: dict[str, list[int]] = {}
    for k, (word, *_) in enumerate(wanted):
        own.setdefault(word, []).append(k)
    automaton = ahocorasick.Automaton()
    for word, ranks in own.items():
        automaton.add_word(word, (len(word), ranks))
    if not len(automaton):
        return out
    automaton.make_automaton()
    places: list[list[int]] = [[] for _ in wanted]
    for last, (size, ranks) in automaton.iter(text):
        if _words(text, last + 1 - size, last + 1):
            for k in ranks:
                places[k].append(last + 1 - size)
    for (word, how, person), starts in zip(wanted, places, strict=True):
        free = 0
        for start in starts:
            end = start + len(word)
            if start >= free:
                free = end
                if word.lower() not in terms and 1 not in taken[start:end]:
                    taken[start:end] = b"\x01" * len(word)
                    out.append((start, end, word, how, person))
    return out


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", type_col: str | None = "document_type") -> DataFrame:
    """(id, rule, severity, start_char, end_char, matched_text, how, person): every mention of a person that an honorific brings in; person is the key that mentions share.

    Surnames that several persons have link with the first of them. Documents without an honorific don't reach Python. Null text is empty; repeated rows give repeated findings.
    """
    heavy = F.lower(F.trim(F.col(type_col))).isin(WEIGHTY_TYPES) if type_col else F.lit(False)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(heavy, F.lit(False)).alias("__heavy"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.where(F.col("__text").rlike(NAME)).withColumn("__names", spans.matches("`__text`", NAME)).withColumn("__terms", defined_terms("__text"))
    kept = F.filter("__names", lambda n: undefined(n["matched_text"], F.col("__terms")))
    named = F.transform(kept, lambda n: F.struct(n["start_char"].alias("start_char"), n["end_char"].alias("end_char"), n["matched_text"].alias("matched_text"), stripped(n["matched_text"]).alias("bare"), canonical(n["matched_text"]).alias("person")))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, heavies, texts, names, terms = batch.columns
            found = [(k, *f) for k, (t, n, x) in enumerate(zip(texts, names, terms, strict=True)) for f in _linked(t.as_py(), n.as_py(), set(x.as_py()))]
            if found:
                rows, *columns = (list(c) for c in zip(*found, strict=True))
                take = pa.array(rows)
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([at.take(take), heavies.take(take), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["id", "heavy", "start_char", "end_char", "matched_text", "how", "person"])

    found = rows.select("__id", "__heavy", "__text", named.alias("n"), "__terms")
    found = found.mapInArrow(run, f"id {kind}, heavy boolean, start_char int, end_char int, matched_text string, how string, person string")
    severity = F.when(F.col("heavy"), "high").otherwise("low")
    return found.select(F.col("id").alias(id_col), F.lit("named_person").alias("rule"), severity.alias("severity"), "start_char", "end_char", "matched_text", "how", "person")


def suppressed(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """found (id, matched_text, ...) without findings that are one of their document's defined terms. Only documents that define a term are looked at; terms travel as one array a document."""
    terms = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).select(id_col, defined_terms("__text").alias("__terms")).where(F.size("__terms") > 0)
    both = found.join(terms, id_col, "left")
    return both.where(F.col("__terms").isNull() | undefined(F.col("matched_text"), F.col("__terms"))).drop("__terms")
