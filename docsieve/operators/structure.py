"""Structure of a text: its lines as units with offsets, headings above them, terms that it defines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_kind(line: Column) -> Column:
    return (
        F.when(F.trim(line) == "", "blank")
        .when(line.contains(" | "), "table")
        .when(line.rlike(r"^[ \t]*(?:[-*]|[0-9]+[.)])[ \t]"), "list")
        .when(line.rlike(r"^(?:Signed|Sincerely|By:)"), "signature")
        .when(line.rlike(r'"[A-Z][A-Za-z ]+" means'), "defined_term")
        .when((F.length(line) <= 60) & ~line.rlike(r"[.,;:!?]$"), "heading")
        .otherwise("paragraph")
    )


def units(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, line_no, kind, start_char, end_char, parent_line, island): a row a line. parent_line is the last heading above; paragraphs in a row share an island."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line_no", "line"))
    order = Window.partitionBy(key).orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.select(key, "line_no", unit_kind(F.col("line")).alias("kind"), F.length("line").alias("size"))
    rows = rows.withColumn("start_char", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)).cast("int"))
    rows = rows.withColumn("end_char", F.col("start_char") + F.col("size"))
    rows = rows.withColumn("parent_line", F.last(F.when(F.col("kind") == "heading", F.col("line_no")), True).over(before))
    breaks = (F.col("kind") != F.lag("kind", 1, "").over(order)).cast("int")
    return rows.withColumn("break", breaks).withColumn("island", F.sum("break").over(order).cast("int")).drop("break", "size")


def line_no(text: Column, at: Column) -> Column:
    """The number of the line that a place of a text is on, as units() counts them."""
    before = F.substring(text, F.lit(1), at)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def defined_terms(text: Column) -> Column:
    """Terms of a text in order, without repetition: `"X" means`, `(the "X")`, and names in capitals."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r'"([A-Z][A-Za-z ]+)" means'), F.lit(1)), F.regexp_extract_all(text, F.lit(r'\((?:the )?"([A-Z][A-Za-z ]+)"\)'), F.lit(1)), F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]{4,}"), F.lit(0)))
    return F.array_distinct(F.transform(found, F.lower))


def accumulated(rows: DataFrame, session: str, order: str, terms: str = "terms") -> DataFrame:
    """rows with `known`, the distinct terms of the session's earlier rows."""
    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("known", F.array_distinct(F.flatten(F.collect_list(terms).over(before))))
