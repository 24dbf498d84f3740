"""Scores, risk, policy decisions, lanes and suggestions, as aggregates and CASE expressions over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The decisions by rank.
DECISIONS = ["allow", "warn", "rewrite_required", "approval_required", "block"]
#: Lane by severity, and the document score from which a gated finding is shown.
LANES, GATE = {"high": "always_visible", "medium": "threshold_gated", "low": "batched"}, 60.0


def _category_score(category: str) -> Column:
    own = F.when(F.col("category") == category, F.col("score"))
    return F.when(F.count(own) > 0, F.least(F.lit(100.0), F.max(own) + 3 * (F.count(own) - 1))).otherwise(0.0)


def document_scores(found: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_findings, pii_score, mnpi_score, document_score, risk) of every document, those without findings too."""
    scores = found.groupBy(key).agg(F.count("*").alias("n_findings"), _category_score("PII").alias("pii_score"), _category_score("MNPI").alias("mnpi_score"))
    rows = docs.select(key).join(scores, key, "left").fillna(0, ["n_findings"]).fillna(0.0, ["pii_score", "mnpi_score"])
    top = F.greatest("pii_score", "mnpi_score")
    return rows.withColumn("document_score", top).withColumn("risk", F.when(top >= 70, "HIGH_RISK").when(top >= 35, "LOW_RISK").otherwise("SAFE"))


def finding_rank(approved: Column | None = None, public: Column | None = None) -> Column:
    """Rank of the decision for a finding: high inside information blocks unless public or approved, high personal data has to be rewritten unless approved, the rest warns."""
    approved = F.lit(False) if approved is None else approved
    public = F.lit(False) if public is None else public
    high = F.col("severity") == "high"
    return F.when(high & (F.col("category") == "MNPI"), F.when(public | approved, 1).otherwise(4)).when(high, F.when(approved, 1).otherwise(2)).otherwise(1)


def action(rank: Column) -> Column:
    return F.when(rank == 4, "hold_until_public").when(rank == 2, "redact_pii").when(rank == 1, "review")


def decisions(found: DataFrame, docs: DataFrame, cross_border: Column, key: str = "doc_id") -> DataFrame:
    """(key, decision, send_allowed, actions, blocking_rules) of every document: the highest rank of its findings and its context."""
    rows = found.withColumn("rank", finding_rank())
    by = rows.groupBy(key).agg(F.max("rank").alias("rank"), F.array_sort(F.collect_set(action(F.col("rank")))).alias("actions"), F.array_sort(F.collect_set(F.when(F.col("rank") >= 2, F.col("rule")))).alias("blocking_rules"))
    every = docs.select(key, F.when(cross_border, 1).otherwise(0).alias("context")).join(by, key, "left")
    rank = F.greatest(F.coalesce("rank", F.lit(0)), F.col("context"))
    none = F.expr("cast(array() as array<string>)")
    return every.select(
        key, F.get(F.array(*(F.lit(d) for d in DECISIONS)), rank).alias("decision"), (rank <= 1).alias("send_allowed"),
        F.array_join(F.coalesce("actions", none), ",").alias("actions"), F.array_join(F.coalesce("blocking_rules", none), ",").alias("blocking_rules"),
    )


def lanes(found: DataFrame, scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """found with its lane and whether it is shown. The lane table has a row a severity."""
    table = found.sparkSession.createDataFrame(list(LANES.items()), "severity string, lane string")
    rows = found.join(F.broadcast(table), "severity", "left").join(scores.select(key, "document_score"), key)
    lane = F.coalesce("lane", F.lit("secondary"))
    return rows.withColumn("lane", lane).withColumn("visible", F.when(lane == "always_visible", True).when(lane == "threshold_gated", F.col("document_score") >= GATE).otherwise(False))


def suggestion() -> Column:
    return F.when(F.col("category") == "PII", "redact").when(F.col("severity") == "high", "remove_or_hold").otherwise("verify_or_rewrite")


def attribution(packs: list[str]) -> Column:
    """The jurisdiction that a rule's name begins with, if it is one of the packs, else all of them."""
    first = F.upper(F.substring_index("rule", "_", 1))
    return F.when(first.isin(packs), first).otherwise("+".join(packs))
