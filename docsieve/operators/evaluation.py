"""Detector quality: findings against labels, by rule and over the corpus. Matching is by equality of (document, rule, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["doc_id", "rule", "matched_text"]


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0)), digits)


def outcomes(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Each distinct key once, with expected and detected: one full outer join gives matched, missed and unexpected alike."""
    f = found.select(*KEYS).distinct().withColumn("detected", F.lit(True))
    g = labels.select(*KEYS).distinct().withColumn("expected", F.lit(True))
    return g.join(f, KEYS, "full").na.fill(False, ["expected", "detected"])


def counts() -> list[Column]:
    return [F.count_if(F.col("expected") & F.col("detected")).alias("matched"), F.count_if(F.col("expected") & ~F.col("detected")).alias("missed"), F.count_if(~F.col("expected") & F.col("detected")).alias("unexpected")]


def by_rule(rows: DataFrame) -> DataFrame:
    """Per rule: matched, missed, unexpected, recall, precision."""
    return rows.groupBy("rule").agg(*counts()).withColumn("recall", ratio(F.col("matched"), F.col("matched") + F.col("missed"))).withColumn("precision", ratio(F.col("matched"), F.col("matched") + F.col("unexpected")))


def corpus(rows: DataFrame, beta: float = 2.0) -> DataFrame:
    """One row: counts, precision, recall and F-beta."""
    m, miss, more, b = F.col("matched"), F.col("missed"), F.col("unexpected"), beta * beta
    return rows.agg(*counts()).withColumn("recall", ratio(m, m + miss)).withColumn("precision", ratio(m, m + more)).withColumn("f_beta", ratio((1 + b) * m, (1 + b) * m + b * miss + more))


def miss_cells(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Misses by (rule, lang), by rule, by lang and in all, with the rate per 100 labels of the cell."""
    named = rows.where("expected").join(docs.select("doc_id", "lang"), "doc_id").withColumn("lang", F.coalesce("lang", F.lit("?")))
    cells = named.groupingSets([["rule", "lang"], ["rule"], ["lang"], []], "rule", "lang").agg(F.count_if(~F.col("detected")).alias("n_missed"), F.count("*").alias("n_expected"), F.grouping_id().alias("level"))
    return cells.withColumn("per_100", F.round(100 * F.col("n_missed") / F.col("n_expected"), 2))


def triage() -> Column:
    """What kind a key is, in order of precedence."""
    text = F.col("matched_text")
    return F.when(F.col("expected") & F.col("detected"), "matched").when(F.col("expected"), "missed").when(F.col("rule") == "ip_address", "weak_rule").when(F.length(text) < 16, "short_text").when(text.rlike("[0-9]"), "has_digits").otherwise("needs_review")


def sweep(scored: DataFrame, thresholds: list[int], truth: str = "truth", score: str = "document_score") -> DataFrame:
    """(threshold, flagged, precision, recall, objective) over documents with a truth. One pass: a column of counts for each threshold, then rows."""
    cells = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(score) >= t).alias("flagged"), F.count_if((F.col(score) >= t) & F.col(truth)).alias("hits"), F.count_if(F.col(truth)).alias("positives"), F.count("*").alias("n")) for t in thresholds]
    rows = scored.where(F.col(truth).isNotNull()).agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")
    p, r = F.coalesce(F.col("hits") / F.nullif(F.col("flagged"), F.lit(0)), F.lit(0.0)), F.coalesce(F.col("hits") / F.nullif(F.col("positives"), F.lit(0)), F.lit(0.0))
    return rows.select("threshold", "flagged", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(0.4 * p + 0.4 * r - 0.2 * F.col("flagged") / F.col("n"), 4).alias("objective"))


def calibration(decided: DataFrame) -> DataFrame:
    """(finding_id, accepted, rejected, advice) from decisions with an action."""
    rows = decided.groupBy("finding_id").agg(F.count_if(F.col("action") == "accept").alias("accepted"), F.count_if(F.col("action") == "reject").alias("rejected"))
    n, share = F.col("accepted") + F.col("rejected"), F.col("rejected") / F.nullif(F.col("accepted") + F.col("rejected"), F.lit(0))
    return rows.withColumn("advice", F.when(n < 5, "insufficient_data").when(share >= 0.6, "lower_severity").when(share <= 0.2, "raise_severity").otherwise("keep"))


def against(now: DataFrame, locked: DataFrame, key: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """(key, now, locked, status): a full outer join; a value under the locked one is a regression."""
    rows = now.select(key, F.col(value).alias("now")).join(locked.select(key, F.col(value).alias("locked")), key, "full")
    status = F.when(F.col("locked").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") < F.col("locked") - tolerance, "regressed").when(F.col("now") > F.col("locked") + tolerance, "improved").otherwise("same")
    return rows.withColumn("status", status)
