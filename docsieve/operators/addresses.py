"""Postal addresses in five phases; a phase takes only what none before it has.

1. addresses by the shapes of countries; 2. values of address fields, up to two more lines long; 3. addresses behind a person's name; 4. lines about a person,
with up to two lines after each, that have the substance of an address; 5. shapes of further countries. Lines that only speak of an organisation's office are left out.

All candidates of a document stay in its row, as one array in order of phases; the choice among them marks places in one pass, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from docsieve.functions import places
from docsieve.functions import text as T
from docsieve.operators import spans

#: Which phase a rule's finding comes from, as it is reported.
PHASES = ["country", "labelled", "person", "lines", "late"]
#: Lines with anything but blanks.
_LINE = "[^\\n]*[^\\n \\t\\r][^\\n]*"


def substance(value: Column) -> Column:
    """Whether a text has what an address has: a digit, and words of an address with a postcode, place or region; or a postcode with a place."""
    postcode, locality = value.rlike(places.POSTCODE), value.rlike(places.LOCALITY)
    return value.rlike("[0-9]") & ((value.rlike(places.WORDS_OF_ADDRESS) & (postcode | locality | value.rlike(places.REGION))) | (postcode & locality))


def organisation_only(value: Column) -> Column:
    return value.rlike(places.ORGANISATION) & ~value.rlike(places.PERSON_LINKED)


def _trimmed(start: Column, value: Column) -> Column:
    """(start, value) of a value without blanks around it, nor points and semicolons behind it."""
    behind = lambda v, left: F.struct((start + F.length(v) - F.length(left)).alias("start"), F.regexp_replace(left, "[ \\t\\r\\n.;]+$", "").alias("value"))
    return T.let(value, lambda v: T.let(F.regexp_replace(v, "^[ \\t\\r\\n]+", ""), lambda left: behind(v, left)))


def _with_following(text: Column, x: Column, line: str) -> Column:
    """A match with up to two lines after it, each of which fits the expression and begins no field; the second only behind the first."""
    fits = lambda y: (y != "") & ~F.substring(y, F.lit(2), F.length(y)).rlike(places.FIELD_LINE)
    second = lambda one, two: F.when(fits(two), F.concat(one, two)).otherwise(one)

    def first(rest: Column, one: Column) -> Column:
        return F.when(fits(one), T.let(F.regexp_extract(T.right_of(rest, F.length(one)), line, 0), lambda two: second(one, two))).otherwise("")

    return F.concat(x["matched_text"], T.let(T.right_of(text, x["end_char"]), lambda rest: T.let(F.regexp_extract(rest, line, 0), lambda one: first(rest, one))))


def _candidate(phase: int, rule: str, w: Column, begin: Column | None = None, end: Column | None = None) -> Column:
    """A finding (start, value), and the range from begin to end that has to be free for it; its own, if none is given."""
    start, stop = w["start"], w["start"] + F.length(w["value"])
    whole = {"begin": start if begin is None else begin, "end": stop if end is None else end, "start": start, "stop": stop}
    return F.struct(F.lit(phase).alias("phase"), F.lit(rule).alias("rule"), *(x.cast("int").alias(name) for name, x in whole.items()), w["value"].alias("matched_text"))


def _candidates(found: Column, phase: int, window: Callable[[Column], Column]) -> Column:
    """Findings of a phase from matches, each of which window() makes a (start, value)."""
    return F.transform(F.transform(found, window), lambda w: _candidate(phase, "postal_address", w))


def _of_country(shape: places.Shape, text: Column) -> Column:
    found = spans.matches("`__text`", shape.pattern, lower="`__lower`")
    own = F.filter(found, lambda x: ~organisation_only(T.line_of(text, x["start_char"], x["end_char"])))
    windows = F.transform(own, lambda x: F.struct(x["start_char"].alias("start"), x["matched_text"].alias("value")))
    return F.transform(windows, lambda w: _candidate(5 if shape.late else 1, shape.rule, w))


def _labelled(text: Column) -> Column:
    values = spans.matches("`__text`", places.LABELLED, cap=True)
    found = _candidates(values, 2, lambda x: _trimmed(x["start_char"], _with_following(text, x, places.FOLLOWING)))
    return F.filter(found, lambda c: substance(c["matched_text"]))


def _of_person() -> Column:
    values = spans.matches("`__text`", places.FREEFORM, cap=True)
    found = _candidates(values, 3, lambda x: _trimmed(x["start_char"], x["matched_text"]))
    return F.filter(found, lambda c: substance(c["matched_text"]) & ~organisation_only(c["matched_text"]))


def _behind_first_line(value: Column) -> Column:
    return F.regexp_replace(value, "^[^\\n]*\\n?", "")


def _lines(text: Column) -> Column:
    def window(x: Column) -> Column:
        return _trimmed(x["start_char"], _with_following(text, x, "^\\n[^\\n]*[^\\n \\t\\r][^\\n]*"))

    def narrowed(w: Column) -> Column:
        """The window, or the lines behind its first if those alone are an address."""
        tail = T.let(_behind_first_line(w["value"]), lambda rest: _trimmed(w["start"] + F.length(w["value"]) - F.length(rest), rest))
        chosen = lambda t: F.when(substance(t["value"]) & ~substance(F.substring_index(w["value"], "\n", 1)), t).otherwise(w)
        return T.let(T.let(tail, chosen), lambda c: _candidate(4, "postal_address", c, w["start"], w["start"] + F.length(w["value"])))

    def counts(c: Column) -> Column:
        value = c["matched_text"]
        return substance(value) & ~organisation_only(value) & (~value.contains("\n") | _behind_first_line(value).rlike("[0-9]"))

    personal = F.filter(spans.matches("`__text`", _LINE), lambda x: x["matched_text"].rlike(places.PERSON_LINKED))
    return F.filter(F.transform(F.transform(personal, window), narrowed), counts)


@F.pandas_udf(ArrayType(BooleanType()))
def first_come(size: pd.Series, candidates: pd.Series) -> pd.Series:
    """Which candidates (phase, begin, end, start, stop) of a text of the given size stay: in order, each whose begin to end is free takes start to stop. Those of phase 1 all stay."""

    def one(n: int, rows) -> list[bool]:
        taken, out = bytearray(n), []
        for phase, begin, end, start, stop in rows:
            out.append(bool(phase == 1 or (begin < end and 1 not in taken[begin:end])))
            if out[-1]:
                taken[start:stop] = b"\x01" * (stop - start)
        return out

    return pd.Series([one(n, rows) for n, rows in zip(size, candidates, strict=True)])


def find(docs: DataFrame, packs: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule, phase, start_char, end_char, matched_text) of every address. packs: codes of the countries whose shapes count (all, if none are given).

    Null text is empty; repeated rows give repeated findings. Texts without a digit don't reach Python.
    """
    shapes = [s for s in places.SHAPES if packs is None or s.pack in packs]
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).where(F.col("__text").rlike("[0-9]")).withColumn("__lower", F.lower("__text"))
    text = F.col("__text")
    phases = [*(_of_country(s, text) for s in shapes if not s.late), _labelled(text), _of_person(), _lines(text), *(_of_country(s, text) for s in shapes if s.late)]
    held = rows.select("__id", F.length("__text").alias("__size"), F.concat(*phases).alias("c"))  # no filter on it: the optimizer would push it down and make it twice
    marks = F.transform("c", lambda c: F.array(c["phase"], c["begin"], c["end"], c["start"], c["stop"]))
    kept = held.select("__id", "c", first_come("__size", marks).alias("keep"))
    found = kept.select("__id", F.explode(F.arrays_zip("c", "keep")).alias("x")).where("x.keep").select("__id", "x.c.*")
    phase = F.element_at(F.array(*(F.lit(p) for p in PHASES)), F.col("phase"))
    return found.select(F.col("__id").alias(id_col), "rule", phase.alias("phase"), F.col("start").alias("start_char"), F.col("stop").alias("end_char"), "matched_text")
