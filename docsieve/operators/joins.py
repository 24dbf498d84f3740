"""Joins between spans of one document. What one document's spans are held against travels as an array over the document, so its spans never multiply, and the spans are made once: a join of them with themselves would read every text twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _of_document(rules: list[str], key: str) -> Column:
    """The spans (start_char, end_char) of these rules in the row's document; none for rows without a document."""
    held = F.collect_list(F.when(F.col("rule").isin(rules), F.struct("start_char", "end_char"))).over(Window.partitionBy(key))
    return F.when(F.col(key).isNotNull(), held)


def outside(found: DataFrame, inner: str, outer: list[str], key: str = "doc_id") -> DataFrame:
    """found without the spans of rule `inner` that lie fully inside a span of one of the `outer` rules. Partial overlaps stay."""
    inside = F.exists("__over", lambda o: (o["start_char"] <= F.col("start_char")) & (F.col("end_char") <= o["end_char"]))
    return found.withColumn("__over", _of_document(outer, key)).where((F.col("rule") != inner) | F.col("__over").isNull() | ~inside).drop("__over")


def amplified(found: DataFrame, weak: list[str], triggers: list[str], reach: int = 200, key: str = "doc_id") -> DataFrame:
    """found with weak rules lifted from low to medium where a trigger overlaps their surroundings, both ends inclusive."""
    touches = F.exists("__near", lambda t: (t["end_char"] >= F.greatest(F.col("start_char") - reach, F.lit(0))) & (t["start_char"] <= F.col("end_char") + reach))
    lifted = F.col("rule").isin(weak) & (F.col("severity") == "low") & F.coalesce(touches, F.lit(False))
    rows = found.withColumn("__near", _of_document(triggers, key)).withColumn("__lifted", lifted)
    return rows.withColumn("severity", F.when(F.col("__lifted"), "medium").otherwise(F.col("severity"))).withColumn("score", F.when(F.col("__lifted"), 55.0).otherwise(F.col("score"))).drop("__near", "__lifted")


def linked(found: DataFrame, ids: list[str], person: str = "named_person", key: str = "doc_id") -> DataFrame:
    """found with identifiers lifted from medium to high in documents that name a person."""
    named = F.bool_or(F.col("rule") == person).over(Window.partitionBy(key))
    rows = found.withColumn("__lifted", named & F.col("rule").isin(ids) & (F.col("severity") == "medium"))
    return rows.withColumn("severity", F.when(F.col("__lifted"), "high").otherwise(F.col("severity"))).withColumn("score", F.when(F.col("__lifted"), 85.0).otherwise(F.col("score"))).drop("__lifted")


def accepted(found: DataFrame, priority: Column, key: str = "doc_id") -> DataFrame:
    """The spans that a greedy pass takes, in order of start, then priority, then length, then end: each that begins at or after the end of those taken."""
    size = F.col("end_char") - F.col("start_char")
    entry = F.struct("start_char", (-priority).alias("p"), (-size).alias("l"), "end_char", "rule", "category", "severity", "matched_text")
    kind = "array<struct<start_char:int,p:int,l:int,end_char:int,rule:string,category:string,severity:string,matched_text:string>>"
    taken = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("end"), F.expr(f"cast(array() as {kind})").alias("out")),
        lambda s, x: F.when(x["start_char"] >= s["end"], F.struct(x["end_char"].alias("end"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s),
        lambda s: s["out"],
    )
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(entry)).cast(kind).alias("__spans"))
    return rows.select(key, F.explode(taken).alias("x")).select(key, "x.rule", "x.category", "x.severity", "x.start_char", "x.end_char", "x.matched_text")


def smallest_unit(found: DataFrame, units: DataFrame, key: str = "doc_id") -> DataFrame:
    """found with the smallest unit (unit_id, unit_start, unit_end) that holds each span: least length, then least start."""
    held = found.join(units, key).where("unit_start <= start_char AND end_char <= unit_end")
    order = Window.partitionBy(key, "rule", "start_char", "end_char").orderBy(F.col("unit_end") - F.col("unit_start"), "unit_start")
    return held.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
