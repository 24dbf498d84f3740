"""Queries over the review journal, which the events table stands for, with their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import rules
from docsieve.operators import journal, keychain, spans
from docsieve.plans import oracle
from docsieve.sources import tables

#: Events that a test of the chain alters or loses, and the retention limit.
_ALTERED, _LOST, _KEEP_DAYS, _NOW = 97, 89, 14, "2024-01-31"
_LIMIT, _WINDOW_S = 3, 86400
#: Keys of the test of the keyed chain, and the day from which the second one signs.
_KEYS, _ROTATED = {"v1": b"a key of a test", "v2": b"another key of that test, which is longer than a block of sixty-four bytes"}, "2024-01-16"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.journal(_events(spark, sf_dir))


def journal_replay_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.latest_decisions(_journal(spark, sf_dir))


def journal_chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of a journal of which some rows are altered and some are lost."""
    rows = journal.chained(_journal(spark, sf_dir))
    mark = F.col("review_id") + F.col("seq")
    return journal.chain_check(rows.where(mark % _LOST != 0).withColumn("action", F.when(mark % _ALTERED == 0, "forged").otherwise(F.col("action"))))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal as entries of a keyed chain."""
    payload = F.concat(F.lit('{"action":"'), F.coalesce("action", F.lit("")), F.lit('","finding_id":"'), F.coalesce("finding_id", F.lit("")), F.lit('"}'))
    version = F.when(F.col("ts") < F.lit(_ROTATED).cast("timestamp"), "v1").otherwise("v2")
    return _journal(spark, sf_dir).select("seq", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.coalesce("kind", F.lit("")).alias("event_type"), "review_id", payload.alias("payload"), version.alias("key_version"))


def keyed_chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of a keyed journal with a rotated key, of which some entries are altered, some lost, and some name a key that isn't there."""
    rows = keychain.signed(_entries(spark, sf_dir), _KEYS)
    mark = F.col("review_id") + F.col("seq")
    forged = rows.where(mark % _LOST != 0).withColumns({"payload": F.when(mark % _ALTERED == 0, F.lit("{}")).otherwise(F.col("payload")), "key_version": F.when(mark % 83 == 0, "v0").otherwise(F.col("key_version"))})
    return keychain.verified(forged, _KEYS)


def keyed_chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last HMAC of each review, which seals it: an audit keeps one row a review."""
    rows = keychain.signed(_entries(spark, sf_dir), _KEYS)
    return rows.groupBy("review_id").agg(F.max("seq").alias("last_seq"), F.max_by("hmac", "seq").alias("seal"))


def fp_queue_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.false_positives(_journal(spark, sf_dir))


def fn_queue_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.unresolved_approvals(_journal(spark, sf_dir))


def action_rates_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.action_rates(_journal(spark, sf_dir))


def findings_after_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _journal(spark, sf_dir)
    shown = rows.where("kind = 'finding_shown'").select("review_id", "finding_id").distinct()
    return shown.join(journal.latest_decisions(rows).where("action = 'reject'"), ["review_id", "finding_id"], "left_anti")


def min_wait_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _journal(spark, sf_dir).groupBy("review_id").agg(F.min(F.when(F.col("kind") == "review_started", F.col("ts"))).alias("started"), F.min(F.when(F.col("kind") == "decision_recorded", F.col("ts"))).alias("decided"))
    return rows.where("started IS NOT NULL AND decided IS NOT NULL").select("review_id", (F.col("decided") >= F.col("started") + F.expr("INTERVAL 1 HOUR")).alias("waited"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.find(tables.table(spark, sf_dir, "documents", "doc_id", "text"), rules.IDENTIFIERS)


def subject_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.subject_index(_subjects(spark, sf_dir))


def subject_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after the subjects of every fifth document are erased."""
    index = journal.subject_index(_subjects(spark, sf_dir))
    return index.join(index.where("doc_id % 5 = 0").select("subject_key").distinct(), "subject_key", "left_anti")


def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.col("ts") > F.expr(f"TIMESTAMP_NTZ '{_NOW}' - INTERVAL {_KEEP_DAYS} DAYS")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_purged"))


def idempotent_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.first_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["text", "lang"], "doc_id")


def siem_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    fields = F.create_map(*(x for name, value in (("user_id", F.col("user_id")), ("event_type", F.col("event_type")), ("token", F.col("event_id")), ("api_secret", F.col("event_id")), ("props", F.concat("event_type", F.lit("/"), "props"))) for x in (F.lit(name), F.coalesce(value.cast("string"), F.lit("")))))
    out = journal.sanitised(fields)
    return rows.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(out)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"))


def telemetry_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    category = F.when(kind.startswith("approval"), "approval").when(kind.endswith("_recorded"), "decision").otherwise("review")
    outcome = F.when(kind.endswith("_requested"), "pending").when(kind.endswith("_decided") | kind.endswith("_recorded"), "success").otherwise("info")
    return _journal(spark, sf_dir).groupBy(category.alias("category"), outcome.alias("outcome")).agg(F.count("*").alias("n"))


def rate_limit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.rate_limited(_events(spark, sf_dir), "user_id", _LIMIT, _WINDOW_S)


def event_hourly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.hourly(_events(spark, sf_dir))


def value_report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _journal(spark, sf_dir).rollup("kind", "action").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "accept").alias("n_accepted"), F.grouping_id().alias("level"))
    return rows.withColumn("accept_rate", F.round(F.col("n_accepted") / F.nullif(F.col("n"), F.lit(0)), 4))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(*(F.round(F.percentile("value", p), 6).alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)), F.max("value").alias("max"))


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("value") <= 10, 10).when(F.col("value") <= 50, 50).when(F.col("value") <= 100, 100).otherwise(-1)
    return _events(spark, sf_dir).groupBy("event_type", bucket.alias("le")).agg(F.count("*").alias("n"))



def _hmac(digest: str) -> str:
    """HMAC of an entry of the SQL, by its key's version."""
    text = f"encode(seq::VARCHAR || '|' || ts || '|' || event_type || '|' || review_id::VARCHAR || '|' || payload || '|' || {digest})"

    def one(key: bytes) -> str:
        block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
        inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
        return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {text})))"

    return f"CASE key_version {' '.join(f'WHEN {oracle.quoted(v)} THEN {one(k)}' for v, k in _KEYS.items())} END"


QUERIES = {
    f.__name__: f
    for f in (journal_replay_latest, journal_chain_check, keyed_chain_check, keyed_chain_heads, fp_queue_asof, fn_queue_antijoin, action_rates_pivot, findings_after_decisions, min_wait_gate, subject_index_dedup, subject_erasure, retention_filter, idempotent_first, siem_sanitize, telemetry_outcome, rate_limit_log, event_hourly_metrics, value_report_rollup, latency_percentiles, latency_histogram)
}
_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in journal.KINDS.items()) + " END"
_J = f"""j AS (
  SELECT user_id AS review_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, ts, {_KIND} AS kind,
    json_extract_string(props, '$.k') AS finding_id, CASE WHEN value >= 60 THEN 'accept' WHEN value >= 20 THEN 'reject' ELSE 'edit' END AS action
  FROM events WHERE user_id IS NOT NULL)"""
_DIGEST = "sha256(concat_ws('|', review_id, seq, kind, finding_id, action))"
_LATEST = "l AS (SELECT review_id, finding_id, max_by(action, seq) AS action, count(*) AS n FROM j WHERE kind = 'decision_recorded' GROUP BY ALL)"
_INDEX = f"i AS (SELECT DISTINCT sha256(rule || ':' || lower(trim(matched_text))) AS subject_key, rule, doc_id FROM ({oracle.spans(rules.IDENTIFIERS)}))"
_CHAIN = f"""{_J},
      n AS (SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, coalesce(kind, '') AS event_type, review_id, '{{"action":"' || coalesce(action, '') || '","finding_id":"' || coalesce(finding_id, '') || '"}}' AS payload,
        CASE WHEN ts < TIMESTAMP '{_ROTATED}' THEN 'v1' ELSE 'v2' END AS key_version FROM j),
      c AS (SELECT *, 'GENESIS' AS prev_hash, {_hmac("'GENESIS'")} AS hmac FROM n WHERE seq = 0
            UNION ALL SELECT n.*, c.hmac, {_hmac('c.hmac').replace('seq::VARCHAR', 'n.seq::VARCHAR').replace(' ts ', ' n.ts ').replace(' event_type ', ' n.event_type ').replace(' review_id::', ' n.review_id::').replace(' payload ', ' n.payload ').replace('CASE key_version', 'CASE n.key_version')} FROM n JOIN c ON n.review_id = c.review_id AND n.seq = c.seq + 1)"""
ORACLE_SQL = {
    "journal_replay_latest": f"WITH {_J}, {_LATEST} SELECT * FROM l",
    "keyed_chain_check": f"""WITH RECURSIVE {_CHAIN}, x AS (
        SELECT * REPLACE (CASE WHEN (review_id + seq) % {_ALTERED} = 0 THEN '{{}}' ELSE payload END AS payload, CASE WHEN (review_id + seq) % 83 = 0 THEN 'v0' ELSE key_version END AS key_version)
        FROM c WHERE (review_id + seq) % {_LOST} <> 0),
      y AS (SELECT *, seq <> coalesce(lag(seq) OVER w + 1, 0) AS a, prev_hash <> coalesce(lag(hmac) OVER w, 'GENESIS') AS b, key_version = 'v0' AS k, key_version <> 'v0' AND hmac <> {_hmac('prev_hash')} AS h FROM x WINDOW w AS (PARTITION BY review_id ORDER BY seq))
      SELECT review_id, count(*) AS n, count(*) FILTER (a) AS n_seq_faults, count(*) FILTER (b) AS n_prev_faults, count(*) FILTER (k) AS n_key_faults, count(*) FILTER (h) AS n_hmac_faults,
        count(*) FILTER (a OR b OR k OR h) = 0 AS whole FROM y GROUP BY review_id""",
    "keyed_chain_heads": f"WITH RECURSIVE {_CHAIN} SELECT review_id, max(seq) AS last_seq, arg_max(hmac, seq) AS seal FROM c GROUP BY review_id",
    "journal_chain_check": f"""WITH {_J}, c AS (SELECT *, lag({_DIGEST}, 1, 'GENESIS') OVER (PARTITION BY review_id ORDER BY seq) AS prev_digest FROM j),
      t AS (SELECT * REPLACE (CASE WHEN (review_id + seq) % {_ALTERED} = 0 THEN 'forged' ELSE action END AS action) FROM c WHERE (review_id + seq) % {_LOST} <> 0),
      s AS (SELECT review_id, seq <> row_number() OVER w - 1 AS gap, prev_digest <> lag({_DIGEST}, 1, 'GENESIS') OVER w AS broken FROM t WINDOW w AS (PARTITION BY review_id ORDER BY seq))
      SELECT review_id, count(*) AS n, count(*) FILTER (gap) AS n_gaps, count(*) FILTER (broken) AS n_broken FROM s GROUP BY ALL""",
    "fp_queue_asof": f"""WITH {_J} SELECT d.review_id, d.seq, d.finding_id, s.seq AS start_seq, sha256(concat_ws(':', d.review_id, d.finding_id)) AS queue_id
      FROM (SELECT * FROM j WHERE kind = 'decision_recorded' AND action = 'reject') d ASOF JOIN (SELECT review_id, seq FROM j WHERE kind = 'review_started') s ON d.review_id = s.review_id AND d.seq >= s.seq""",
    "fn_queue_antijoin": f"""WITH {_J} SELECT review_id, seq, finding_id FROM j a WHERE kind = 'approval_requested'
      AND NOT EXISTS (SELECT 1 FROM j d WHERE d.review_id = a.review_id AND d.kind = 'approval_decided' AND d.seq > a.seq)""",
    "action_rates_pivot": f"""WITH {_J} SELECT finding_id, count(*) FILTER (action = 'accept') AS accept, count(*) FILTER (action = 'reject') AS reject, count(*) FILTER (action = 'edit') AS edit,
      round(count(*) FILTER (action = 'reject') / count(*), 4) AS reject_rate FROM j WHERE kind = 'decision_recorded' GROUP BY finding_id""",
    "findings_after_decisions": f"WITH {_J}, {_LATEST} SELECT DISTINCT review_id, finding_id FROM j WHERE kind = 'finding_shown' AND NOT EXISTS (SELECT 1 FROM l WHERE l.review_id = j.review_id AND l.finding_id = j.finding_id AND l.action = 'reject')",
    "min_wait_gate": f"""WITH {_J}, g AS (SELECT review_id, min(ts) FILTER (kind = 'review_started') AS started, min(ts) FILTER (kind = 'decision_recorded') AS decided FROM j GROUP BY 1)
      SELECT review_id, decided >= started + INTERVAL 1 HOUR AS waited FROM g WHERE started IS NOT NULL AND decided IS NOT NULL""",
    "subject_index_dedup": f"WITH {_INDEX} SELECT * FROM i",
    "subject_erasure": f"WITH {_INDEX} SELECT * FROM i WHERE subject_key NOT IN (SELECT subject_key FROM i WHERE doc_id % 5 = 0)",
    "retention_filter": f"SELECT event_type, count(*) FILTER (ts > TIMESTAMP '{_NOW}' - INTERVAL {_KEEP_DAYS} DAY) AS n_kept, count(*) FILTER (NOT ts > TIMESTAMP '{_NOW}' - INTERVAL {_KEEP_DAYS} DAY) AS n_purged FROM events GROUP BY 1",
    "idempotent_first": "SELECT doc_id, k AS idempotency_key, doc_id <> min(doc_id) OVER (PARTITION BY k) AS duplicate FROM (SELECT doc_id, sha256(coalesce(text, '') || '|' || coalesce(lang, '')) AS k FROM documents)",
    "siem_sanitize": "SELECT event_id, 'event_type=' || substr(event_type, 1, 12) || ';props=' || substr(event_type || '/' || props, 1, 12) || ';user_id=' || substr(sha256(user_id::VARCHAR), 1, 16) AS fields FROM events",
    "telemetry_outcome": f"""WITH {_J} SELECT CASE WHEN kind LIKE 'approval%' THEN 'approval' WHEN kind LIKE '%\\_recorded' ESCAPE '\\' THEN 'decision' ELSE 'review' END AS category,
      CASE WHEN kind LIKE '%requested' THEN 'pending' WHEN kind LIKE '%decided' OR kind LIKE '%recorded' THEN 'success' ELSE 'info' END AS outcome, count(*) AS n FROM j GROUP BY 1, 2""",
    "rate_limit_log": f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      w AS (SELECT user_id, n, event_id, true AS allowed, [t] AS log FROM e WHERE n = 1
        UNION ALL SELECT user_id, n, event_id, len(kept) < {_LIMIT}, CASE WHEN len(kept) < {_LIMIT} THEN list_append(kept, t) ELSE kept END
        FROM (SELECT e.*, list_filter(w.log, lambda x: x > e.t - {_WINDOW_S}000000) AS kept FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
      SELECT event_id, user_id, allowed FROM w""",
    "event_hourly_metrics": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "value_report_rollup": f"WITH {_J} SELECT kind, action, count(*) AS n, count(*) FILTER (action = 'accept') AS n_accepted, grouping(kind, action)::BIGINT AS level, round(count(*) FILTER (action = 'accept') / count(*), 4) AS accept_rate FROM j GROUP BY ROLLUP (kind, action)",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max FROM events GROUP BY 1",
    "latency_histogram": "SELECT event_type, CASE WHEN value <= 10 THEN 10 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 ELSE -1 END AS le, count(*) AS n FROM events GROUP BY 1, 2",
}
