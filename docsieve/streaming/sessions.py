"""State of sessions over streams: terms that a session has defined so far, and reviews that expire when nothing happens.

Both keep named state with transformWithState, which needs the RocksDB state store; `provider` sets it. State is bounded: terms by their time to live, reviews by a timer that removes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from docsieve.operators import persons

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def provider(spark: SparkSession) -> None:
    """Sets the state store that lists, timers and time to live need, where the session hasn't."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


class _Terms(StatefulProcessor):
    """The terms of a session, each once, for a time after it was last defined."""

    def __init__(self, ttl_ms: int | None) -> None:
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._terms = handle.getMapState("terms", StructType([StructField("term", StringType())]), StructType([StructField("turn", LongType())]), self._ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("turn", kind="stable")
        out = []
        for turn, terms in zip(frame["turn"], frame["terms"], strict=True):
            for term in terms:
                if not self._terms.containsKey((term,)):
                    out.append((key[0], int(turn), term))
                self._terms.updateValue((term,), (int(turn),))
        yield pd.DataFrame(out, columns=["session_id", "turn", "term"])

    def close(self) -> None:
        pass


def session_terms(turns: DataFrame, ttl_ms: int | None = 30 * 24 * 3600 * 1000, session: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(session_id, turn, term): each term of each session when it is first defined, over a stream of turns. A term that isn't defined again within ttl_ms is forgotten; without ttl_ms none is, and the query ends when it has read all (availableNow), which one with a clock doesn't."""
    provider(turns.sparkSession)
    found = turns.where(F.col(session).isNotNull()).select(F.col(session).cast("long").alias("session_id"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = found.select("session_id", "turn", persons.defined_terms("__text").alias("terms")).where(F.size("terms") > 0)
    return rows.groupBy("session_id").transformWithStateInPandas(_Terms(ttl_ms), "session_id long, turn long, term string", "Append", "ProcessingTime" if ttl_ms else "None")


class _Expiry(StatefulProcessor):
    """The last event of a review and a timer behind it."""

    def __init__(self, idle_ms: int) -> None:
        self._idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", StructType([StructField("last_ms", LongType()), StructField("n", IntegerType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, n = self._last.get() if self._last.exists() else (0, 0)
        for frame in rows:
            last, n = max(last, int(frame["ms"].max())), n + len(frame)
        for timer in self._handle.listTimers():
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(last + self._idle_ms)
        self._last.update((last, n))
        yield pd.DataFrame([], columns=["review_id", "last_ms", "n_events", "expired_ms"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, n = self._last.get()
        self._last.clear()
        yield pd.DataFrame([(key[0], last, n, expiredTimerInfo.getExpiryTimeInMs())], columns=["review_id", "last_ms", "n_events", "expired_ms"])

    def close(self) -> None:
        pass


def expired_reviews(events: DataFrame, idle: str = "7 days", late: str = "1 hour", review: str = "user_id") -> DataFrame:
    """(review_id, last_ms, n_events, expired_ms): reviews without an event for so long, when the watermark has passed that; a later event begins the review anew."""
    provider(events.sparkSession)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    timed = events.where(F.col(review).isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select(F.col(review).cast("long").alias("review_id"), "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("review_id").transformWithStateInPandas(_Expiry(idle_ms), "review_id long, last_ms long, n_events int, expired_ms long", "Append", "EventTime")
