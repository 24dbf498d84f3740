"""Rewriting texts around accepted spans: placeholders, opaque marks, and back again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Placeholder type by rule; other rules have their own name in capitals.
TYPES = {"email_address": "EMAIL", "ip_address": "IP", "phone_number": "PHONE", "payment_card": "CARD", "external_secret_hex": "SECRET", "named_person": "PERSON"}


def priority() -> Column:
    """100 for personal data, 50 for inside information, and 30, 20 or 10 by severity."""
    return F.when(F.col("category") == "PII", 100).otherwise(50) + F.when(F.col("severity") == "high", 30).when(F.col("severity") == "medium", 20).otherwise(10)


def entity_type() -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv)), F.col("rule")), F.upper("rule"))


def canonical(kind: Column, value: Column) -> Column:
    return F.when(kind.isin("PHONE", "CARD"), F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(value))


def numbered(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Accepted spans with entity_type, canonical and placeholder `[TYPE_n]`: n counts the entities of a type by first appearance."""
    rows = spans.withColumn("entity_type", entity_type())
    rows = rows.withColumn("canonical", canonical(F.col("entity_type"), F.col("matched_text")))
    first = F.min("start_char").over(Window.partitionBy(key, "entity_type", "canonical"))
    n = F.dense_rank().over(Window.partitionBy(key, "entity_type").orderBy("first_char"))
    return rows.withColumn("first_char", first).withColumn("placeholder", F.concat(F.lit("["), "entity_type", F.lit("_"), n.cast("string"), F.lit("]")))


def opaque(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Numbered spans with placeholder `[REDACTED_n]`: one count over all entities of a document."""
    n = F.dense_rank().over(Window.partitionBy(key).orderBy("first_char"))
    return rows.withColumn("placeholder", F.concat(F.lit("[REDACTED_"), n.cast("string"), F.lit("]")))


def spliced(docs: DataFrame, rows: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (key, text) with each span of rows replaced by its placeholder, and the number replaced."""
    by = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "placeholder"))).alias("__spans"))
    text = F.col(text_col)
    built = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda s, x: F.struct(x["end_char"].alias("at"), F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start_char"] - s["at"]), x["placeholder"])).alias("out")),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))),
    )
    joined = docs.select(key, text_col).join(by, key, "left")
    return joined.select(key, F.coalesce(built, text).alias(text_col), F.coalesce(F.size("__spans"), F.lit(0)).alias("n_replaced"))


def mapping(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, placeholder, entity_type, original_text, occurrence_count); the original is the first one's."""
    return rows.groupBy(key, "placeholder", "entity_type").agg(F.min_by("matched_text", "start_char").alias("original_text"), F.count("*").alias("occurrence_count"))


def restored(docs: DataFrame, mapped: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with placeholders put back, the longest first."""
    by = mapped.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.length("placeholder").alias("n"), "placeholder", "original_text")), asc=False).alias("__map"))
    joined = docs.join(by, key, "left")
    back = F.aggregate("__map", F.col(text_col), lambda t, m: F.replace(t, m["placeholder"], m["original_text"]))
    return joined.withColumn(text_col, F.coalesce(back, F.col(text_col))).drop("__map")
