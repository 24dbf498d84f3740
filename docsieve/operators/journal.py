"""Analytics of an append-only review journal. A session is a key with ordered events; nothing needs an order over all sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event types of the source table and the journal's kinds.
KINDS = {"signup": "review_started", "view": "finding_shown", "click": "decision_recorded", "error": "approval_requested", "purchase": "approval_decided"}
#: Keys that exported events lose, and those whose values are hashed; longer texts are cut.
DROPPED_KEYS, HASHED_KEYS, CUT_AT = ["text", "token"], ["user_id", "matched_text"], 12


def action(value: Column) -> Column:
    return F.when(value >= 60, "accept").when(value >= 20, "reject").otherwise("edit")


def journal(events: DataFrame) -> DataFrame:
    """(review_id, seq, ts, kind, finding_id, action): seq counts from 0 within a review. Rows without a user belong to no review."""
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.where("user_id IS NOT NULL").withColumn("seq", (F.row_number().over(order) - 1).cast("long"))
    return rows.select(F.col("user_id").alias("review_id"), "seq", "ts", F.element_at(kind, F.col("event_type")).alias("kind"), F.get_json_object("props", "$.k").alias("finding_id"), action(F.col("value")).alias("action"))


def latest_decisions(rows: DataFrame) -> DataFrame:
    """(review_id, finding_id, action, n): the last decision of each finding wins."""
    return rows.where("kind = 'decision_recorded'").groupBy("review_id", "finding_id").agg(F.max_by("action", "seq").alias("action"), F.count("*").alias("n"))


def digest() -> Column:
    return F.sha2(F.concat_ws("|", "review_id", "seq", "kind", "finding_id", "action"), 256)


def chained(rows: DataFrame) -> DataFrame:
    """rows with the digest of the row before in the session; the first has GENESIS."""
    before = F.lag(digest(), 1, "GENESIS").over(Window.partitionBy("review_id").orderBy("seq"))
    return rows.withColumn("prev_digest", before)


def chain_check(rows: DataFrame) -> DataFrame:
    """(review_id, n, n_gaps, n_broken): gaps in seq, and rows whose prev_digest isn't that of the row before."""
    order = Window.partitionBy("review_id").orderBy("seq")
    seen = rows.withColumn("gap", F.col("seq") != F.row_number().over(order) - 1).withColumn("broken", F.col("prev_digest") != F.lag(digest(), 1, "GENESIS").over(order))
    return seen.groupBy("review_id").agg(F.count("*").alias("n"), F.count_if("gap").alias("n_gaps"), F.count_if("broken").alias("n_broken"))


def false_positives(rows: DataFrame) -> DataFrame:
    """Rejected findings with the last start of their review before the decision (an as-of join within the session, by one window)."""
    started = F.last(F.when(F.col("kind") == "review_started", F.col("seq")), ignorenulls=True).over(Window.partitionBy("review_id").orderBy("seq"))
    return rows.withColumn("start_seq", started).where("kind = 'decision_recorded' AND action = 'reject' AND start_seq IS NOT NULL").select("review_id", "seq", "finding_id", "start_seq", F.sha2(F.concat_ws(":", "review_id", "finding_id"), 256).alias("queue_id"))


def unresolved_approvals(rows: DataFrame) -> DataFrame:
    """Approvals asked for and never decided later. The latest decision is an aggregate, so no pair of events of a session is made."""
    decided = rows.where("kind = 'approval_decided'").groupBy("review_id").agg(F.max("seq").alias("last_seq"))
    asked = rows.where("kind = 'approval_requested'").join(decided, "review_id", "left")
    return asked.where("last_seq IS NULL OR last_seq < seq").select("review_id", "seq", "finding_id")


def action_rates(rows: DataFrame) -> DataFrame:
    """Per finding: decisions by action, and the share of rejections."""
    counts = rows.where("kind = 'decision_recorded'").groupBy("finding_id").pivot("action", ["accept", "reject", "edit"]).agg(F.count(F.lit(1))).na.fill(0)
    return counts.withColumn("reject_rate", F.round(F.col("reject") / (F.col("accept") + F.col("reject") + F.col("edit")), 4))


def subject_index(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(subject_key, rule, key): one entry for each subject in each document."""
    return found.select(F.sha2(F.concat_ws(":", "rule", F.lower(F.trim("matched_text"))), 256).alias("subject_key"), "rule", key).distinct()


def first_of(rows: DataFrame, fields: list[str], order: str) -> DataFrame:
    """rows with the key of their fields and whether an earlier row has it. The first of a key is an aggregate, so a hot key isn't sorted."""
    keyed = rows.withColumn("idempotency_key", F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)), 256))
    first = keyed.groupBy("idempotency_key").agg(F.min(order).alias("first"))
    return keyed.join(first, "idempotency_key").select(order, "idempotency_key", (F.col(order) != F.col("first")).alias("duplicate"))


def sanitised(fields: Column) -> Column:
    """A map of strings without dropped keys; values of hashed keys are digests, long ones are cut."""
    kept = F.map_filter(fields, lambda k, v: ~k.isin(DROPPED_KEYS) & ~k.endswith("_secret"))
    return F.transform_values(kept, lambda k, v: F.when(k.isin(HASHED_KEYS), F.substring(F.sha2(v, 256), 1, 16)).otherwise(F.substring(v, 1, CUT_AT)))


def rate_limited(events: DataFrame, key: str, limit: int, window_s: int) -> DataFrame:
    """(event_id, key, allowed): at most `limit` allowed calls in a sliding window; denied calls don't count.

    The state depends on the decisions before, so a key's events are walked in order, in a stream of sorted batches: memory holds
    `limit` times, whatever a key's length.
    """
    kinds = f"event_id long, {key} {events.schema[key].dataType.simpleString()}, allowed boolean"
    rows = events.where(F.col(key).isNotNull()).select("event_id", key, F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, log = object(), []
        for batch in batches:
            allowed = []
            for name, t in zip(batch[key], batch["t"], strict=True):
                if name != last:
                    last, log = name, []
                log = [x for x in log if x > t - window_s * 1_000_000]
                allowed.append(len(log) < limit)
                if allowed[-1]:
                    log.append(t)
            yield batch[["event_id", key]].assign(allowed=allowed)

    return rows.repartition(key).sortWithinPartitions(key, "t", "event_id").mapInPandas(walk, kinds)


def hourly(events: DataFrame) -> DataFrame:
    """(hour, event_type, n, total): counts and sums by hour; the same for a stream."""
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
