"""Queries over record sheets, units of memos, and what becomes of reviews, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsieve.functions import rules
from docsieve.operators import fields, joins, reident, spans, structure
from docsieve.plans import audit, documents, memos, oracle, quality
from docsieve.sources import carrier, registrations, rule_packs, sentences, tables

#: Rules that a large number inside them gives way to.
OVER_LARGE = ["financial_amount", "financial_percentage", "crypto_wallet_address", "eu_company_id", "uk_company_number", "payment_card", "phone_number"]
_RECORDS = rule_packs.load().of("RECORDS")
_LARGE = [r for r in rules.MNPI if r.name in ("financial_amount", "large_number")]
_MARKED = [*rules.FIELD_IDENTIFIERS, *rules.PRIVACY_EVENTS, *rules.MNPI, *rules.PROXIMITY]
_WEAK = [r.name for r in rules.PROXIMITY]
#: Delivery status by policy decision; fixed values.
STATUS = {"allow": "allowed", "warn": "warned", "approval_required": "held_for_approval", "rewrite_required": "held_for_rewrite", "block": "blocked"}
#: Documents that a language needs for each stage of a corpus.
_STAGES = [(1000, "large"), (100, "medium"), (1, "small")]


def record_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.review(registrations.records(spark, sf_dir), _RECORDS, id_col="c_custkey")


def large_number_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large numbers that no stronger finding holds and that aren't all zeros, beside the stronger findings."""
    docs = registrations.records(spark, sf_dir)
    found = fields.review(docs, _RECORDS, id_col="c_custkey").unionByName(spans.find(docs, _LARGE, id_col="c_custkey"))
    found = joins.outside(found, "large_number", OVER_LARGE, "c_custkey")
    return found.where("rule <> 'large_number' OR matched_text RLIKE '[1-9]'").select("c_custkey", "rule", "start_char", "end_char", "matched_text")


def marker_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field identifiers, events of privacy law, inside information and weak markers over sheets that hold each of them, in part negated."""
    return spans.find(registrations.markers(spark, sf_dir), _MARKED, id_col="c_custkey").select("c_custkey", "rule", "severity", "start_char", "end_char", "matched_text")


def planted_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was planted against what is found, by rule: plain sentences, and sentences behind a negation; the truth is the generator's."""
    docs = sentences.sentences(spark, sf_dir)
    names = F.element_at(F.array(*(F.lit(r.name) for r in sentences.PLANTED)), F.col("k") + 1)
    found = spans.find(docs, sentences.PLANTED).select("doc_id", "rule").distinct().withColumn("found", F.lit(True))
    rows = docs.withColumn("rule", names).join(found, ["doc_id", "rule"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return rows.groupBy("rule").agg(
        F.count_if(~F.col("negated")).alias("n_plain"), F.count_if(~F.col("negated") & F.col("found")).alias("n_plain_found"), F.count_if(F.col("negated")).alias("n_negated"), F.count_if(F.col("negated") & F.col("found")).alias("n_negated_found"))


def marker_amplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak markers by severity, lifted where a trigger stands within 200 characters."""
    found = spans.find(registrations.markers(spark, sf_dir), [*rules.MNPI, *rules.PROXIMITY], id_col="c_custkey")
    lifted = joins.amplified(found, _WEAK, rules.TRIGGERS, key="c_custkey").where(F.col("rule").isin(_WEAK))
    return lifted.select("c_custkey", "rule", "start_char", "severity", "score")


def forbidden_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected texts that must not be detected; here, whatever documents of other languages hold, guarded or not."""
    found = documents._found(spark, sf_dir).select("doc_id", "rule", "matched_text").distinct()
    docs = documents._docs(spark, sf_dir)
    forbidden = spans.find(docs.where("lang <> 'en'"), rules.IDENTIFIERS, guarded=False).select("doc_id", "matched_text").distinct()
    return found.join(forbidden, ["doc_id", "matched_text"]).select("doc_id", "rule", "matched_text")


def slice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and misses by rule, by language and by source, all in one pass."""
    rows = quality._outcomes(spark, sf_dir).join(documents._docs(spark, sf_dir).select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source")), "doc_id")
    slices = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("rule", "lang", "source")))
    counts = rows.select(F.explode(slices).alias("s"), "expected", "detected").groupBy("s.key", "s.value").agg(
        F.count_if(F.expr("expected AND detected")).alias("matched"), F.count_if(F.expr("expected AND NOT detected")).alias("missed"), F.count_if(F.expr("NOT expected AND detected")).alias("unexpected"))
    share = lambda other: F.round(F.col("matched") / F.nullif(F.col("matched") + F.col(other), F.lit(0)), 4)
    return counts.withColumns({"recall": share("missed"), "precision": share("unexpected")})


def corpus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each language's documents, and the stage that their number has reached."""
    docs = tables.table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").withColumn("lang", F.coalesce("lang", F.lit("?")))
    hits = documents._found(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("hits"), F.count_if(F.col("severity") == "high").alias("high"))
    rows = docs.join(hits, "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("n_documents"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("n_empty"), F.countDistinct("source").alias("n_sources"),
        F.count_if(F.col("hits") > 0).alias("n_with_findings"), F.count_if(F.col("high") > 0).alias("n_high"), F.coalesce(F.sum("hits"), F.lit(0)).alias("n_findings"),
    )
    stage = F.lit("none")
    for least, name in reversed(_STAGES):
        stage = F.when(F.col("n_documents") >= least, name).otherwise(stage)
    return rows.withColumn("stage", stage)


def operation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Privacy operations by day: what the journal's kinds count as."""
    operation = F.when(F.col("kind") == "decision_recorded", F.concat(F.lit("decision_"), "action")).otherwise(F.col("kind"))
    return audit._journal(spark, sf_dir).groupBy(operation.alias("operation"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("review_id").alias("n_reviews"))


def singling_out_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of memos whose quasi-identifiers are of three rules or weigh 1.4 together. The line of a span is told beside its text, and the rules of a line are bits, so that one sum by line is all that is shuffled."""
    docs = carrier.memos(spark, sf_dir).select(F.struct("doc_id", "text").alias("held"), "text")
    found = spans.find(docs, memos._QUASI, id_col="held")
    bit = F.create_map(*(F.lit(x) for k, r in enumerate(memos._QUASI) for x in (r.name, 1 << k)))
    found = found.select("held.doc_id", structure.line_no(F.col("held.text"), F.col("start_char")).alias("unit"), F.element_at(bit, F.col("rule")).cast("long").alias("bit"), "start_char", "end_char")
    units = found.groupBy("doc_id", "unit").agg(F.bit_or("bit").alias("bits"), F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"))
    weight = sum((F.when(F.col("bits").bitwiseAND(1 << k) != 0, reident.WEIGHTS[r.name]).otherwise(0.0) for k, r in enumerate(memos._QUASI) if r.name in reident.WEIGHTS), F.lit(0.0))
    rows = units.select("doc_id", "unit", F.bit_count("bits").cast("long").alias("n_rules"), F.round(weight, 6).alias("weight"), "start_char", "end_char")
    return rows.where("n_rules >= 3 OR weight >= 1.4")


def findings_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their number in the document's output."""
    order = Window.partitionBy("doc_id").orderBy("start_char", "end_char", "rule")
    return documents._found(spark, sf_dir).select("doc_id", F.row_number().over(order).alias("idx"), "rule", "start_char")


def delivery_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by what a document system does with them: the policy's decision as a status, and whether they may be sent."""
    status = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    rows = documents.policy_decision(spark, sf_dir).select(F.coalesce(F.element_at(status, F.col("decision")), F.lit("backend_failure")).alias("status"), "send_allowed")
    return rows.groupBy("status", F.expr("send_allowed AND status IN ('allowed', 'warned')").alias("may_send")).agg(F.count("*").alias("n_documents"))


def _started_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted or rejected findings of reviews that had started by then."""
    order = Window.partitionBy("review_id").orderBy("seq")
    started = F.last(F.when(F.col("kind") == "review_started", F.col("seq")), ignorenulls=True).over(order)
    return audit._journal(spark, sf_dir).withColumn("start_seq", started).where("kind = 'decision_recorded' AND start_seq IS NOT NULL AND action IN ('accept', 'reject')")


def preference_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions as pairs of a chosen and a rejected answer."""
    return _started_decisions(spark, sf_dir).select("review_id", "seq", "finding_id", F.col("action").alias("chosen"), F.when(F.col("action") == "accept", "reject").otherwise("accept").alias("rejected"))


def promotion_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided findings as candidates of a test corpus: accepted ones are positive, rejected ones adversarial."""
    queue = F.when(F.col("action") == "accept", "positive_candidate").otherwise("adversarial_candidate")
    return _started_decisions(spark, sf_dir).groupBy("finding_id", queue.alias("queue")).agg(F.count("*").alias("n"), F.countDistinct("review_id").alias("n_reviews"))


def audit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a review: its events by kind, its action counts, and a seal over its chain of digests."""
    rows = audit._journal(spark, sf_dir).withColumn("line", F.concat_ws("|", "review_id", "seq", "kind", "finding_id", "action"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: F.sha2(x["line"], 256))
    return rows.groupBy("review_id").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("kind") == "decision_recorded").alias("n_decisions"), F.count_if(F.expr("kind = 'decision_recorded' AND action = 'reject'")).alias("n_rejected"),
        F.sha2(F.array_join(lines, ""), 256).alias("seal"),
    )


QUERIES = {
    f.__name__: f
    for f in (record_spans, marker_spans, planted_markers, marker_amplified, large_number_outside, forbidden_matches, slice_scores, corpus_status, operation_counts, singling_out_units, findings_in_order, delivery_status, preference_export, promotion_queue, audit_pack)
}
_SHEETS = f"sheets AS ({registrations.RECORD_SQL})"
_MARKERS = f"markers AS ({registrations.MARKER_SQL})"
_STARTED = f"""WITH {audit._J}, d AS (SELECT * FROM j WHERE kind = 'decision_recorded' AND action IN ('accept', 'reject')
  AND EXISTS (SELECT 1 FROM (SELECT review_id AS r, min(seq) AS first FROM j WHERE kind = 'review_started' GROUP BY 1) WHERE r = j.review_id AND first <= j.seq))"""
ORACLE_SQL = {
    "record_spans": f"WITH {_SHEETS} {oracle.packs(_RECORDS, 'sheets', 'c_custkey')}",
    "marker_spans": f"WITH {_MARKERS}, f AS ({oracle.spans(_MARKED, 'markers', 'c_custkey')}) SELECT c_custkey, rule, severity, start_char, end_char, matched_text FROM f",
    "planted_markers": f"""WITH sentences AS ({sentences.SQL}), f AS (SELECT DISTINCT doc_id, rule FROM ({oracle.spans(sentences.PLANTED, 'sentences')}))
      SELECT [{', '.join(f"'{r.name}'" for r in sentences.PLANTED)}][k + 1] AS rule, count(*) FILTER (NOT negated) AS n_plain, count(*) FILTER (NOT negated AND f.rule IS NOT NULL) AS n_plain_found,
        count(*) FILTER (negated) AS n_negated, count(*) FILTER (negated AND f.rule IS NOT NULL) AS n_negated_found
      FROM sentences s LEFT JOIN f ON f.doc_id = s.doc_id AND f.rule = [{', '.join(f"'{r.name}'" for r in sentences.PLANTED)}][k + 1] GROUP BY 1""",
    "marker_amplified": f"""WITH {_MARKERS}, f AS ({oracle.spans([*rules.MNPI, *rules.PROXIMITY], 'markers', 'c_custkey')}),
      t AS (SELECT c_custkey, list({{'s': start_char, 'e': end_char}}) AS near FROM f WHERE rule IN ({', '.join(map(oracle.quoted, rules.TRIGGERS))}) GROUP BY 1),
      x AS (SELECT f.*, severity = 'low' AND len(list_filter(coalesce(near, []), lambda o: o.e >= greatest(start_char - 200, 0) AND o.s <= end_char + 200)) > 0 AS lifted FROM f LEFT JOIN t USING (c_custkey))
      SELECT c_custkey, rule, start_char, CASE WHEN lifted THEN 'medium' ELSE severity END AS severity, CASE WHEN lifted THEN 55 ELSE score END::DOUBLE AS score FROM x WHERE rule IN ({', '.join(map(oracle.quoted, _WEAK))})""",
    "large_number_outside": f"""WITH {_SHEETS}, f AS ({oracle.packs(_RECORDS, 'sheets', 'c_custkey')} UNION ALL {oracle.spans(_LARGE, 'sheets', 'c_custkey')})
      SELECT c_custkey, rule, start_char, end_char, matched_text FROM f WHERE rule <> 'large_number' OR (length(replace(replace(matched_text, ',', ''), '0', '')) > 0 AND NOT EXISTS (
        SELECT 1 FROM f o WHERE o.c_custkey = f.c_custkey AND o.rule IN ({', '.join(map(oracle.quoted, OVER_LARGE))}) AND o.start_char <= f.start_char AND f.end_char <= o.end_char))""",
    "forbidden_matches": f"""WITH {documents._FOUND}, b AS ({oracle.spans(rules.IDENTIFIERS, guarded=False)})
      SELECT DISTINCT f.doc_id, f.rule, f.matched_text FROM found f JOIN documents d ON d.doc_id = f.doc_id WHERE d.lang <> 'en' AND (f.doc_id, f.matched_text) IN (SELECT (doc_id, matched_text) FROM b)""",
    "slice_scores": f"""WITH {quality._OUT}, x AS (SELECT o.*, unnest([{{'key': 'rule', 'value': rule}}, {{'key': 'lang', 'value': coalesce(lang, '?')}}, {{'key': 'source', 'value': coalesce(source, '?')}}]) AS s FROM o JOIN documents USING (doc_id)),
      c AS (SELECT s.key AS key, s.value AS value, {quality._COUNTS} FROM x GROUP BY ALL) SELECT *, {quality._RATES} FROM c""",
    "corpus_status": f"""WITH {documents._FOUND}, h AS (SELECT doc_id, count(*) AS hits, count(*) FILTER (severity = 'high') AS high FROM found GROUP BY 1),
      c AS (SELECT coalesce(lang, '?') AS lang, count(*) AS n_documents, count(*) FILTER (coalesce(text, '') = '') AS n_empty, count(DISTINCT source) AS n_sources, count(*) FILTER (hits > 0) AS n_with_findings,
        count(*) FILTER (high > 0) AS n_high, coalesce(sum(hits), 0)::BIGINT AS n_findings FROM documents LEFT JOIN h USING (doc_id) GROUP BY 1)
      SELECT *, CASE {' '.join(f"WHEN n_documents >= {n} THEN '{s}'" for n, s in _STAGES)} ELSE 'none' END AS stage FROM c""",
    "operation_counts": f"WITH {audit._J} SELECT CASE kind WHEN 'decision_recorded' THEN 'decision_' || action ELSE kind END AS operation, ts::DATE AS day, count(*) AS n, count(DISTINCT review_id) AS n_reviews FROM j GROUP BY 1, 2",
    "singling_out_units": f"""WITH {memos._MEMOS}, f AS ({memos._OF(memos._QUASI)}),
      r AS (SELECT f.doc_id, length(substr(text, 1, start_char)) - length(replace(substr(text, 1, start_char), chr(10), '')) AS unit, rule, min(start_char) AS s, max(end_char) AS e, max({memos._W}) AS w FROM f JOIN memos USING (doc_id) GROUP BY ALL)
      SELECT doc_id, unit::INT AS unit, count(*) AS n_rules, round(sum(w), 6) AS weight, min(s) AS start_char, max(e) AS end_char FROM r GROUP BY ALL HAVING count(*) >= 3 OR round(sum(w), 6) >= 1.4""",
    "findings_in_order": f"WITH {documents._FOUND} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_char, end_char, rule)::INT AS idx, rule, start_char FROM found",
    "delivery_status": f"""WITH p AS ({documents.ORACLE_SQL['policy_decision']}), s AS (SELECT CASE decision {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items())} ELSE 'backend_failure' END AS status, send_allowed FROM p)
      SELECT status, send_allowed AND status IN ('allowed', 'warned') AS may_send, count(*) AS n_documents FROM s GROUP BY ALL""",
    "preference_export": f"{_STARTED} SELECT review_id, seq, finding_id, action AS chosen, CASE action WHEN 'accept' THEN 'reject' ELSE 'accept' END AS rejected FROM d",
    "promotion_queue": f"{_STARTED} SELECT finding_id, CASE action WHEN 'accept' THEN 'positive_candidate' ELSE 'adversarial_candidate' END AS queue, count(*) AS n, count(DISTINCT review_id) AS n_reviews FROM d GROUP BY 1, 2",
    "audit_pack": f"""WITH {audit._J} SELECT review_id, count(*) AS n_events, count(*) FILTER (kind = 'decision_recorded') AS n_decisions, count(*) FILTER (kind = 'decision_recorded' AND action = 'reject') AS n_rejected,
      sha256(string_agg({audit._DIGEST}, '' ORDER BY seq)) AS seal FROM j GROUP BY 1""",
}
