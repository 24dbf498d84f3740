"""The batch operators over streams: files of events or documents come in, tables go out. State is bounded by watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docsieve.functions.rules import IDENTIFIERS
from docsieve.operators import joins, journal, scoring, spans
from docsieve.functions import rules


def files(spark: SparkSession, folder: str, schema: str, per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """journal.hourly over a stream; hours close when the watermark has passed them."""
    return journal.hourly(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late))


def once(events: DataFrame, fields: list[str], within: str = "1 day") -> DataFrame:
    """The first event of each key of fields; repetitions within the time are dropped."""
    keyed = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("idempotency_key", F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)), 256))
    return keyed.withWatermark("ts", within).dropDuplicatesWithinWatermark(["idempotency_key"])


def rate_limited(events: DataFrame, key: str, limit: int, window_s: int) -> DataFrame:
    """journal.rate_limited over a stream: the state of a key is the times of its allowed calls in the window, at most `limit`; idle keys expire."""
    kind = events.schema[key].dataType.simpleString()
    timed = events.where(F.col(key).isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours")
    rows = timed.select("event_id", key, "ts", F.unix_micros("ts").alias("t"))

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        calls = pd.concat(list(frames)).sort_values(["t", "event_id"])
        allowed = []
        for t in calls["t"]:
            log = [x for x in log if x > t - window_s * 1_000_000]
            allowed.append(len(log) < limit)
            if allowed[-1]:
                log.append(int(t))
        state.update((log,))
        state.setTimeoutTimestamp(max(int(calls["t"].max()) // 1000, state.getCurrentWatermarkMs()) + window_s * 1000)
        yield calls[["event_id", key]].assign(allowed=allowed)

    return rows.groupBy(key).applyInPandasWithState(step, f"event_id long, {key} {kind}, allowed boolean", "log array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def reviews(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Reviews each batch of (doc_id, text) with the batch operators: findings, scores, a decision a document, as Parquet by batch."""

    def review(batch: DataFrame, number: int) -> None:
        found = joins.outside(spans.find(batch, IDENTIFIERS), "phone_number", rules.OVER_PHONE)
        scoring.decisions(found, batch, F.lit(False)).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch writes the same folder

    return docs.writeStream.foreachBatch(review).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
