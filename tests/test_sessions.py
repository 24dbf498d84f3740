"""Sessions over streams: terms found once over several batches, reviews that expire by event time."""

import datetime as dt

import pytest

from docsieve.streaming import sessions


@pytest.fixture
def restored(spark):
    """The session's state store as it was."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    yield
    spark.conf.set(key, old)


def _run(stream, tmp_path, name):
    """What a query has written when it has taken all that is there."""
    out = str(tmp_path / name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    return out


def test_session_terms_once_over_batches(spark, restored, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    parts = [
        [(1, 0, "user", 'the deal (the "Purchaser") and "Closing Date" means May'), (2, 0, "user", '(the "Vendor")'), (None, 1, "user", '(the "Nobody")')],
        [(1, 1, "user", '(the "Purchaser") again, (the "Escrow")'), (2, None, "user", None), (2, 3, "user", '("Vendor") and ("Agent")')],
    ]
    source = tmp_path / "in"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        out = _run(sessions.session_terms(stream, None), tmp_path, "terms")
        found = sorted(tuple(r) for r in spark.read.parquet(out).select("session_id", "turn", "term").collect())
        assert found == [[(1, 0, "closing date"), (1, 0, "purchaser"), (2, 0, "vendor")], [(1, 0, "closing date"), (1, 0, "purchaser"), (1, 1, "escrow"), (2, 0, "vendor"), (2, 3, "agent")]][k]


def test_reviews_expire(spark, restored, tmp_path):
    schema = "event_id long, ts timestamp, user_id long"
    day = lambda d: dt.datetime(2024, 1, d)
    parts = [[(1, day(1), 1), (2, day(2), 1), (3, day(2), 2), (4, day(2), None)], [(5, day(6), 2)], [(6, day(20), 3)], [(7, day(21), 1), (8, day(21), 3)], [(9, day(30), 4)], [(10, day(30), 4)]]
    source = tmp_path / "in"
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        out = _run(sessions.expired_reviews(spark.readStream.schema(schema).parquet(str(source)), "7 days", "1 hour"), tmp_path, "expired")
    ms = lambda d: int(day(d).replace(tzinfo=dt.UTC).timestamp() * 1000)
    found = sorted(tuple(r) for r in spark.read.parquet(out).select("review_id", "last_ms", "n_events", "expired_ms").collect())
    assert found == sorted([(1, ms(2), 2, ms(9)), (2, ms(6), 2, ms(13)), (1, ms(21), 1, ms(28)), (3, ms(21), 2, ms(28))])
