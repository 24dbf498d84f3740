"""Minors: ages and grades looked up against the cliffs of the jurisdictions that a document falls under, and phrases that tell it without an age.

An age is a point, a cliff an interval from 0; the packs whose interval holds the age are those that it triggers. Below the lowest cliff of all that apply the finding is high, below some it is medium,
above all it is none. A phrase is high under all of them. The cliffs are a small table of the code, held as an array beside each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import ages
from docsieve.functions import text as T
from docsieve.operators import keywords, spans

_FALLBACK = "SG"


def cliffs_of(packs: Column) -> Column:
    """Array of (pack, cliff) of the packs that have one, in the order of the table; of SG, if none has."""
    every = F.array(*(F.struct(F.lit(p).alias("pack"), F.lit(c).alias("cliff")) for p, c in ages.CLIFFS.items()))
    own = F.filter(every, lambda x: F.array_contains(packs, x["pack"]))
    return F.when(F.size(own) > 0, own).otherwise(F.filter(every, lambda x: x["pack"] == _FALLBACK))


def _of_kind(text: Column, pattern: str, grade: str) -> Column:
    """Array of (start_char, end_char, matched_text, age, explicit) of one way to tell an age or a grade."""

    def real(x: Column) -> Column:
        ok = ~F.substring(text, x["end_char"] + 1, F.lit(ages.AFTER)).rlike(ages.NOT_AFTER)
        return ok & ~T.back(text, x["start_char"], ages.BEFORE).rlike(ages.NOT_BEFORE) if grade == "grade" else ok

    def aged(x: Column) -> Column:
        number = F.regexp_extract(x["matched_text"], "[0-9]+", 0).cast("int") + dict(ages.GRADES).get(grade, 0)
        return F.struct(x["start_char"].alias("start_char"), x["end_char"].alias("end_char"), x["matched_text"].alias("matched_text"), number.alias("age"), F.lit(grade == "").alias("explicit"))

    return F.transform(F.filter(spans.matches("`__text`", pattern, lower="`__lower`"), real), aged)


def _told(text: Column) -> Column:
    """The ages and grades of a text; ages of grown-up persons aren't among them."""
    return F.filter(F.concat(*(_of_kind(text, *kind) for kind in ages.TOLD)), lambda x: ~x["explicit"] | (x["age"] <= ages.MOST_AGE))


def find(docs: DataFrame, packs: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule, severity, age, triggered, start_char, end_char, matched_text); triggered: the packs whose cliff the age is below, or all that apply where no age is told.

    packs is an array of the codes that a document falls under. Null text is empty; repeated rows give repeated findings.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), cliffs_of(packs).alias("__cliffs")).withColumn("__lower", F.lower("__text"))
    told = rows.select("__id", "__cliffs", F.explode(_told(F.col("__text"))).alias("x")).select("__id", "__cliffs", "x.start_char", "x.end_char", "x.matched_text", "x.age")
    marked = keywords.hits(rows.select(F.struct("__id", "__cliffs").alias("__key"), "__text"), ages.PHRASES, 0, ages.AFTER, "__key", "__text", with_text=True).where(~F.col("right").rlike(ages.NOT_AFTER))
    marked = marked.select("__key.__id", "__key.__cliffs", "start_char", "end_char", F.col("found").alias("matched_text"), F.lit(None).cast("int").alias("age"))
    found = told.unionByName(marked)
    hit = F.filter("__cliffs", lambda c: F.col("age").isNull() | (F.col("age") < c["cliff"]))
    lowest = F.array_min(F.transform("__cliffs", lambda c: c["cliff"]))
    severity = F.when(F.col("age").isNull() | (F.col("age") < lowest), "high").otherwise("medium")
    found = spans.once(found, triggered=F.transform(hit, lambda c: c["pack"]), severity=severity).where(F.size("triggered") > 0)
    return found.select(F.col("__id").alias(id_col), F.lit("minor_data_reference").alias("rule"), "severity", "age", F.array_join("triggered", "+").alias("triggered"), "start_char", "end_char", "matched_text")
