"""Identifiers told by a field's name: national identifiers of member states, and driver's licences with the state that issued them.

All names of fields go into one lexicon. What stands behind a name is taken apart in columns; formats and countries are small tables of the code, so they are joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import licences, national, vocabulary
from docsieve.operators import keywords, spans

#: Characters behind a name that its value may take.
_AFTER = 80


def _value(right: Column, shape: str, before: str, behind: str = r"\b") -> tuple[Column, Column]:
    """A value of the shape behind a field's name (empty: none), and where it ends, from the name's end on."""
    return F.regexp_extract(right, rf"{before}({shape}){behind}", 1), F.length(F.regexp_extract(right, rf"{before}(?:{shape})", 0))


def national_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule, member_state, validator, start_char, end_char, matched_text): values behind a national identifier's name that have their country's shape and pass its check.

    validator tells what was checked: a checksum, a date, or the field's name alone. Names, countries and checks: functions.national. Null text is empty.
    """
    fields = national.fields()
    lexicon, first = [], set()
    for k, (name, country, checked) in enumerate(fields):
        if vocabulary.normal(name) not in first:
            first.add(vocabulary.normal(name))
            lexicon.append((k, country, checked))
    spark = docs.sparkSession
    names = F.broadcast(spark.createDataFrame(lexicon, "phrase int, member_state string, checked boolean"))
    found = keywords.hits(docs, [name for name, *_ in fields], after=_AFTER, id_col=id_col, text_col=text_col).join(names, "phrase")
    value, stop = F.lit(""), F.lit(0)
    for c in national.COUNTRIES:
        own, end = _value(F.col("right"), c.shape, national.SIGN)
        value, stop = F.when(F.col("member_state") == c.code, own).otherwise(value), F.when(F.col("member_state") == c.code, end).otherwise(stop)
    rows = spans.once(found, stop=F.col("end_char") + stop, matched_text=value)
    rows = spans.once(rows.where("matched_text <> ''"), plain=national.compact(F.col("matched_text")))
    kept = rows.where(~F.col("checked") | national.valid(F.col("member_state"), F.col("matched_text"), F.col("plain")))
    validator = F.when(~F.col("checked"), "label").when(F.col("member_state") == "DK", "date_shape").otherwise("checksum")
    return kept.select(id_col, F.lit("eu_national_id").alias("rule"), "member_state", validator.alias("validator"), (F.col("stop") - F.length("matched_text")).alias("start_char"), F.col("stop").alias("end_char"), "matched_text")


def _first_state(text: Column, codes: Column, names: Column) -> Column:
    """Code of the first state that a state's field in the text names, by code or name; of two words that are no state, the first alone may be."""
    told = F.transform(F.regexp_extract_all(text, F.lit(licences.TOLD), 1), lambda x: F.upper(F.regexp_replace(x, r"\s+", " ")))
    code = lambda x: F.when(F.array_contains(codes, x), x).otherwise(F.try_element_at(names, x))
    either = F.transform(told, lambda x: F.coalesce(code(x), code(F.substring_index(x, " ", 1))))
    return F.get(F.filter(either, lambda x: x.isNotNull()), F.lit(0))


def licence_fields(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, state, outcome, confidence, start_char, end_char, matched_text) of every field of a driver's licence.

    outcome: valid (the number has its state's format), invalid, masked, unsupported_state, missing_state. The state is the one right before the field's name,
    else the first that a state's field tells within REACH characters on either side.
    """
    spark = docs.sparkSession
    found = keywords.hits(docs, licences.LABELS, licences.REACH, licences.REACH + 40, id_col, text_col)
    codes = F.array(*(F.lit(code) for code, *_ in licences.STATES))
    names = F.create_map(*(F.lit(x) for code, name, _ in licences.STATES for x in (name.upper(), code)))
    number, stop = _value(F.col("right"), licences.NUMBER, licences.SIGN, licences.BEHIND)
    rows = spans.once(found, number=number, stop=stop).where("number <> ''")
    right = F.expr(f"substr(right, stop + 1, {licences.REACH})")
    before = F.upper(F.regexp_replace(F.regexp_extract("left", licences.BEFORE, 1), r"\s+", " "))
    explicit = F.when(F.array_contains(codes, before), before).otherwise(F.try_element_at(names, before))
    window = F.concat("left", F.lit(" . "), right)
    capitals = F.nullif(F.regexp_extract(F.expr(f"right(left, {licences.SHORT_REACH})"), licences.CAPITALS, 1), F.lit(""))
    near = F.concat(F.expr(f"right(left, {licences.SHORT_REACH})"), F.lit(" . "), F.expr(f"substr(right, stop + 1, {licences.SHORT_REACH})"))
    told = F.nullif(F.upper(F.regexp_replace(F.regexp_extract(near, licences.TOLD, 1), r"\s+", " ")), F.lit(""))
    rows = rows.select(
        id_col, "number", (F.col("end_char") + F.col("stop")).alias("end_char"), F.coalesce(explicit, _first_state(window, codes, names)).alias("state"), F.coalesce(capitals, told).alias("other"),
        F.upper(F.regexp_replace("number", r"[\s-]", "")).alias("plain"), F.regexp_replace("number", r"[\s-]", "").rlike(licences.MASKED).alias("masked"),
    )
    formats = F.broadcast(spark.createDataFrame([(code, f"^(?:{shape})$") for code, _, shape in licences.STATES], "state string, format string"))
    rows = rows.join(formats, "state", "left")
    fits = F.expr("plain RLIKE format")
    outcome = (
        F.when(F.col("state").isNotNull(), F.when(F.col("masked"), F.lit("masked")).when(fits, F.lit("valid")).otherwise("invalid"))
        .when(F.array_contains(codes, F.col("other")), F.when(F.col("masked"), F.lit("masked")).otherwise("missing_state"))
        .when(F.col("other").isNotNull(), "unsupported_state")
        .otherwise("missing_state")
    )
    rows = rows.withColumn("outcome", outcome)
    confidence = F.create_map(*(F.lit(x) for pair in licences.WARNINGS.items() for x in pair))
    return rows.select(id_col, "state", "outcome", F.try_element_at(confidence, F.col("outcome")).alias("confidence"), (F.col("end_char") - F.length("number")).alias("start_char"), "end_char", F.col("number").alias("matched_text"))


def driver_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule, state, start_char, end_char, matched_text) of the licences whose number has its state's format."""
    return licence_fields(docs, id_col, text_col).where("outcome = 'valid'").select(id_col, F.lit("us_driver_license").alias("rule"), "state", "start_char", "end_char", "matched_text")
