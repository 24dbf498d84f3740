"""Operators by hand-made rows, and streams against the batch results."""

import pandas as pd
from pyspark.sql import functions as F

from docsieve.functions import checks, rules
from docsieve.operators import evaluation, journal, reident, similarity, spans
from docsieve.plans import memos
from docsieve.sources import html
from docsieve.streaming import jobs


def test_spans_of_awkward_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a@b.co"), (4, "é😀 x@y.org, x@y.org"), (5, "no-reply@x.org")], "doc_id long, text string")
    found = spans.find(docs, rules.IDENTIFIERS[:1]).collect()
    assert sorted((r["doc_id"], r["start_char"], r["end_char"], r["matched_text"]) for r in found) == [(3, 0, 6, "a@b.co"), (4, 3, 10, "x@y.org"), (4, 12, 19, "x@y.org")]


def test_checks(spark):
    rows = spark.createDataFrame([("4111111111111111", "S1234567D", "123-45-6789")], "card string, nric string, ssn string")
    assert tuple(rows.select(checks.luhn(F.col("card")), checks.nric(F.col("nric")), checks.us_ssn(F.col("ssn"))).first()) == (True, True, True)


def _seeds(rows, reach=500, least=3):
    out = []
    for key in sorted({r[0] for r in rows}):
        own, i = sorted((s, e, rule) for k, rule, s, e in rows if k == key), 0
        while i < len(own):
            near = [x for x in own[i:] if x[0] <= own[i][0] + reach]
            n = len({x[2] for x in near})
            if n >= least:
                out.append((key, near[0][0], max(x[1] for x in near), n))
                i += len(near)
            else:
                i += 1
    return out


def test_quasi_seeds(spark, sf_dir):
    rows = [(1, "a", 0, 5), (1, "b", 100, 110), (1, "c", 500, 505), (1, "a", 501, 509), (1, "b", 600, 605), (1, "c", 700, 705), (2, "a", 0, 5), (2, "a", 10, 15), (2, "b", 20, 25)]
    found = spark.createDataFrame(rows, "doc_id long, rule string, start_char int, end_char int")
    assert sorted(map(tuple, reident.seeds(found).collect())) == _seeds(rows)
    assert memos.carrier_quasi_seed(spark, sf_dir).count() > 0


def test_greedy_matches(spark):
    kind = "doc_id long, start_char int, end_char int"
    predicted = spark.createDataFrame([(1, 0, 5), (1, 4, 9), (2, 0, 3)], kind)
    gold = spark.createDataFrame([(1, 2, 6), (3, 0, 1)], kind)
    assert sorted(map(tuple, reident.greedy_matches(predicted, gold).collect())) == [(1, 2, 1, 1), (2, 1, 0, 0), (3, 0, 1, 0)]


def test_evaluation(spark):
    kind = "doc_id long, rule string, matched_text string"
    found = spark.createDataFrame([(1, "r", "a"), (1, "r", "b")], kind)
    labels = spark.createDataFrame([(1, "r", "a"), (2, "r", "a"), (2, "r", "a")], kind)
    row = evaluation.corpus(evaluation.outcomes(found, labels)).first()
    assert (row["matched"], row["missed"], row["unexpected"], row["recall"], row["precision"], row["f_beta"]) == (1, 1, 1, 0.5, 0.5, 0.5)
    nothing = evaluation.corpus(evaluation.outcomes(found.where("false"), labels.where("false"))).first()
    assert nothing["matched"] == 0 and nothing["recall"] is None


def test_chain_check_sees_changes(spark):
    rows = spark.createDataFrame([(7, k, "finding_shown", str(k), "edit") for k in range(5)], "review_id long, seq long, kind string, finding_id string, action string")
    chained = journal.chained(rows)
    assert tuple(journal.chain_check(chained).first()) == (7, 5, 0, 0)
    forged = chained.withColumn("action", F.when(F.col("seq") == 2, "accept").otherwise(F.col("action")))
    assert tuple(journal.chain_check(forged).first()) == (7, 5, 0, 1)
    assert tuple(journal.chain_check(chained.where("seq <> 1")).first()) == (7, 4, 3, 1)


def test_nearest_without_tokens(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "zzz")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "beta alpha"), (4, "alpha beta"), (6, "gamma")], "item_id long, text string")
    assert [tuple(r) for r in similarity.nearest(docs, items, "doc_id", "item_id").collect()] == [(1, 4, 1.0)]


def test_visible_text(spark):
    page = '<title>T</title><script>var a="</p>";</script><p>One &amp; two<!-- no --> <b>three</b></p><img alt="hid">'
    rows = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string").select(html.visible_text(F.col("html")).alias("t"), html.hidden_values(F.col("html")).alias("h")).collect()
    assert rows[0]["t"].strip() == "T\nOne & two three" and rows[0]["h"] == ["hid"]
    assert (rows[1]["t"], rows[1]["h"]) == ("", [])


def _drained(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return df.sparkSession.table(name)


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").limit(400)
    folder = str(tmp_path / "events")
    events.coalesce(1).write.parquet(folder)
    stream = lambda: jobs.files(spark, folder, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    hours = sorted(map(str, journal.hourly(events).collect()))
    assert sorted(map(str, _drained(jobs.hourly(stream()), "hourly", "complete").collect())) == hours
    limited = {tuple(r) for r in journal.rate_limited(events, "user_id", 2, 864000).collect()}
    assert {tuple(r) for r in _drained(jobs.rate_limited(stream(), "user_id", 2, 864000), "limited").collect()} == limited
    assert not all(x[2] for x in limited)
    first = _drained(jobs.once(stream(), ["user_id", "event_type"], "60 days"), "once")
    assert first.count() == events.select("user_id", "event_type").distinct().count()


def test_stream_of_reviews(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "docs"))
    query = jobs.reviews(jobs.files(spark, str(tmp_path / "docs"), "doc_id long, text string"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert query.exception() is None
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_python_spans(spark):
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": [1, 2], "text": ["x12 y", None]}))
    assert [tuple(r) for r in spans.find_python(docs, [("n", r"(?<=x)([0-9]+)")]).collect()] == [(1, "n", 1, 3, "12")]
