"""Queries over documents, pages and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import rules
from docsieve.functions.rules import Rule
from docsieve.operators import joins, mapping_store, rewrite, scoring, spans, structure
from docsieve.plans import oracle
from docsieve.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.outside(spans.find(_docs(spark, sf_dir), rules.IDENTIFIERS), "phone_number", rules.OVER_PHONE)


_FOUND = f"""
raw AS ({oracle.spans(rules.IDENTIFIERS)}),
found AS (
  SELECT * FROM raw f WHERE rule <> 'phone_number' OR NOT EXISTS (
    SELECT 1 FROM raw o WHERE o.doc_id = f.doc_id AND o.rule IN ({', '.join(map(oracle.quoted, rules.OVER_PHONE))})
      AND o.start_char <= f.start_char AND f.end_char <= o.end_char))"""
_PRIORITY = "(CASE category WHEN 'PII' THEN 100 ELSE 50 END + CASE severity WHEN 'high' THEN 30 WHEN 'medium' THEN 20 ELSE 10 END)"
#: The greedy pass as recursion over a document's spans in order.
_ACCEPTED = f"""{_FOUND},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_char, -{_PRIORITY}, start_char - end_char, end_char, rule) AS n FROM found),
walk AS (
  SELECT doc_id, n, true AS taken, end_char AS upto FROM ranked WHERE n = 1
  UNION ALL
  SELECT r.doc_id, r.n, r.start_char >= w.upto, CASE WHEN r.start_char >= w.upto THEN r.end_char ELSE w.upto END
  FROM walk w JOIN ranked r ON r.doc_id = w.doc_id AND r.n = w.n + 1),
accepted AS (SELECT r.* FROM ranked r JOIN walk w USING (doc_id, n) WHERE taken)"""
_TYPE = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rewrite.TYPES.items()) + " ELSE upper(rule) END"
_NUMBERED = f"""{_ACCEPTED},
typed AS (SELECT *, {_TYPE} AS entity_type FROM accepted),
keyed AS (SELECT *, CASE WHEN entity_type IN ('PHONE', 'CARD') THEN regexp_replace(matched_text, '[^0-9]', '', 'g') ELSE lower(matched_text) END AS canonical FROM typed),
firsts AS (SELECT *, min(start_char) OVER (PARTITION BY doc_id, entity_type, canonical) AS first_char FROM keyed),
numbered AS (SELECT *, '[' || entity_type || '_' || dense_rank() OVER (PARTITION BY doc_id, entity_type ORDER BY first_char) || ']' AS placeholder FROM firsts),
opaque AS (SELECT * REPLACE ('[REDACTED_' || dense_rank() OVER (PARTITION BY doc_id ORDER BY first_char) || ']' AS placeholder) FROM numbered)"""


def _spliced(name: str) -> str:
    return f"""
pieces AS (SELECT s.doc_id, start_char, placeholder, end_char, lag(end_char, 1, 0) OVER (PARTITION BY s.doc_id ORDER BY start_char) AS since FROM {name} s),
built AS (
  SELECT p.doc_id, string_agg(substr(text, since + 1, start_char - since) || placeholder, '' ORDER BY start_char) AS head, max(end_char) AS upto, count(*) AS n
  FROM pieces p JOIN documents USING (doc_id) GROUP BY p.doc_id)"""


def _spans_query(name: str, rule: Rule) -> None:
    QUERIES[name] = lambda spark, sf_dir: spans.find(_docs(spark, sf_dir), [rule])
    ORACLE_SQL[name] = oracle.spans([rule])


for _name, _rule in zip(["span_email", "span_ipv4", "span_phone_us", "span_card_luhn", "span_hex_token_entropy"], rules.IDENTIFIERS, strict=True):
    _spans_query(_name, _rule)
_LICENSE = Rule("license_line", "PII", "low", r"(?i:licensed under|released under|license, version)[^\n.]*")
_spans_query("span_license_line", _LICENSE)


def span_fused_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.find(_docs(spark, sf_dir), [*rules.IDENTIFIERS, _LICENSE], guarded=False)


def ctx_line_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    lines = spans.with_lines(spans.find(docs, rules.IDENTIFIERS), docs)
    return lines.select("doc_id", "rule", "start_char", F.length("line").alias("line_chars"), F.sha2("line", 256).alias("line_sha256"))


def phone_contained_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


def overlap_resolve_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.accepted(_found(spark, sf_dir), rewrite.priority())


def doc_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.document_scores(_found(spark, sf_dir), _docs(spark, sf_dir)).drop("risk")


def doc_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.document_scores(_found(spark, sf_dir), _docs(spark, sf_dir)).groupBy("risk").agg(F.count("*").alias("n_documents"), F.sum("n_findings").alias("n_findings"))


def policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.decisions(_found(spark, sf_dir), _docs(spark, sf_dir), F.col("lang") != "en")


def lane_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    return scoring.lanes(found, scoring.document_scores(found, _docs(spark, sf_dir))).select("doc_id", "rule", "start_char", "lane", "visible")


def suggestion_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).withColumn("suggestion", scoring.suggestion()).groupBy("rule", "suggestion").agg(F.count("*").alias("n"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.numbered(overlap_resolve_fold(spark, sf_dir))


def pseudonymize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.spliced(_docs(spark, sf_dir), _numbered(spark, sf_dir)).select("doc_id", "n_replaced", F.sha2("text", 256).alias("text_sha256"))


#: The key of the test of the mapping store, and the days that it keeps.
_STORE_KEY, _STORE_FROM, _STORE_DAYS = b"sixteen bytes of", "2024-03-01", 20


def mapping_store_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By day and type: originals in the sealed store, those that open again, that lie there in clear, that open with another key or in another document's place, and that a purge of the first ten days keeps."""
    day = F.date_add(F.lit(_STORE_FROM).cast("date"), (F.col("doc_id") % _STORE_DAYS).cast("int"))
    stored = mapping_store.sealed(rewrite.mapping(_numbered(spark, sf_dir)).withColumn("day", day), _STORE_KEY, F.col("day"))
    back, other = mapping_store.opened(stored, _STORE_KEY), mapping_store.opened(stored, _STORE_KEY[::-1])
    moved = mapping_store.opened(stored.withColumn("doc_id", F.col("doc_id") + 1), _STORE_KEY)
    marks = [back.select("stored_on", "entity_type", F.lit(k).alias("k"), "original_text") for k, back in (("open", back), ("other", other), ("moved", moved))]
    clear = stored.select("stored_on", "entity_type", F.lit("stored").alias("k"), F.unbase64("secret").cast("string").alias("original_text"))
    rows = marks[0].unionByName(marks[1]).unionByName(marks[2]).unionByName(clear)
    opens = lambda k: F.count_if((F.col("k") == k) & F.col("original_text").isNotNull())
    readable = F.count_if((F.col("k") == "stored") & F.col("original_text").rlike("^[ -~]*$"))
    kept = F.count_if((F.col("k") == "open") & (F.col("stored_on") >= F.date_add(F.lit(_STORE_FROM).cast("date"), _STORE_DAYS // 2)))
    return rows.groupBy("stored_on", "entity_type").agg(F.count_if(F.col("k") == "stored").alias("n_stored"), opens("open").alias("n_opened"), readable.alias("n_clear"), opens("other").alias("n_other_key"), opens("moved").alias("n_moved"), kept.alias("n_kept"))


def pseudonym_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.mapping(_numbered(spark, sf_dir))


def redact_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.spliced(_docs(spark, sf_dir), rewrite.opaque(_numbered(spark, sf_dir))).select("doc_id", "n_replaced", F.sha2("text", 256).alias("text_sha256"))


def reidentify_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rows = _docs(spark, sf_dir), _numbered(spark, sf_dir)
    back = rewrite.restored(rewrite.spliced(docs, rows), rewrite.mapping(rows))
    same = back.join(docs.select("doc_id", F.col("text").alias("original")), "doc_id")
    return same.select("doc_id", (F.lower("text") == F.lower("original")).alias("restored"))


def safe_rewrite_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    taken = joins.accepted(found, rewrite.priority()).select("doc_id", "rule", "start_char", F.lit(True).alias("taken"))
    rows = found.join(taken, ["doc_id", "rule", "start_char"], "left")
    why = F.when(F.col("taken").isNull(), "overlap").when(F.col("severity") == "low", "low_severity")
    return rows.select("doc_id", "rule", "start_char", "end_char", why.alias("skip_reason"), F.when(why.isNull(), "[REDACTED PERSONAL DATA]").alias("replacement"))


def structure_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.units(_docs(spark, sf_dir)).select("doc_id", "line_no", "kind", "start_char", "end_char", "island")


def structure_parent_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.units(_docs(spark, sf_dir)).where("parent_line IS NOT NULL").select("doc_id", "line_no", "parent_line")


def smallest_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    units = structure.units(docs).select("doc_id", F.col("line_no").alias("unit_id"), F.col("start_char").alias("unit_start"), F.col("end_char").alias("unit_end"))
    return joins.smallest_unit(spans.find(docs, rules.IDENTIFIERS), units).select("doc_id", "rule", "start_char", "unit_id")


def defined_terms_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("terms", structure.defined_terms(F.coalesce("text", F.lit(""))))
    return structure.accumulated(turns, "conv_id", "turn").select("conv_id", "turn", F.size("terms").alias("n_terms"), F.size("known").alias("n_known"))


QUERIES |= {
    f.__name__: f
    for f in (span_fused_all, ctx_line_guard, phone_contained_antijoin, overlap_resolve_fold, doc_score, doc_risk, policy_decision, lane_partition, suggestion_actions, pseudonymize_text, pseudonym_mapping, mapping_store_check, redact_opaque, reidentify_roundtrip, safe_rewrite_plan, structure_units, structure_parent_heading, smallest_unit, defined_terms_session)
}
_SCORES = f"""{_FOUND},
scores AS (
  SELECT doc_id, count(*) AS n,
    CASE WHEN count(*) FILTER (category = 'PII') > 0 THEN least(100, max(score) FILTER (category = 'PII') + 3 * (count(*) FILTER (category = 'PII') - 1)) ELSE 0 END::DOUBLE AS pii,
    CASE WHEN count(*) FILTER (category = 'MNPI') > 0 THEN least(100, max(score) FILTER (category = 'MNPI') + 3 * (count(*) FILTER (category = 'MNPI') - 1)) ELSE 0 END::DOUBLE AS mnpi
  FROM found GROUP BY doc_id),
reviews AS (
  SELECT doc_id, coalesce(n, 0) AS n_findings, coalesce(pii, 0)::DOUBLE AS pii_score, coalesce(mnpi, 0)::DOUBLE AS mnpi_score,
         greatest(coalesce(pii, 0), coalesce(mnpi, 0))::DOUBLE AS document_score
  FROM documents LEFT JOIN scores USING (doc_id))"""
_KIND = r"""CASE WHEN trim(line) = '' THEN 'blank' WHEN contains(line, ' | ') THEN 'table'
  WHEN regexp_matches(line, '^[ \t]*(?:[-*]|[0-9]+[.)])[ \t]') THEN 'list' WHEN regexp_matches(line, '^(?:Signed|Sincerely|By:)') THEN 'signature'
  WHEN regexp_matches(line, '"[A-Z][A-Za-z ]+" means') THEN 'defined_term'
  WHEN length(line) <= 60 AND NOT regexp_matches(line, '[.,;:!?]$') THEN 'heading' ELSE 'paragraph' END"""
_UNITS = f"""
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
kinds AS (SELECT doc_id, line_no::INT AS line_no, {_KIND} AS kind, length(line) AS size FROM lines),
units AS (
  SELECT *, coalesce(sum(size + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_char,
    last_value(CASE WHEN kind = 'heading' THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_line,
    (kind <> lag(kind, 1, '') OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS brk
  FROM kinds)"""
ORACLE_SQL |= {
    "span_fused_all": oracle.spans([*rules.IDENTIFIERS, _LICENSE], guarded=False),
    "ctx_line_guard": f"""WITH f AS ({oracle.spans(rules.IDENTIFIERS)}), x AS (
      SELECT doc_id, rule, start_char, (SELECT {oracle.LINE} FROM (SELECT text AS t, start_char AS s, end_char AS e)) AS line FROM f JOIN documents USING (doc_id))
      SELECT doc_id, rule, start_char, length(line)::INT AS line_chars, sha256(line) AS line_sha256 FROM x""",
    "phone_contained_antijoin": f"WITH {_FOUND} SELECT * FROM found",
    "overlap_resolve_fold": f"WITH RECURSIVE {_ACCEPTED} SELECT doc_id, rule, category, severity, start_char, end_char, matched_text FROM accepted",
    "doc_score": f"WITH {_SCORES} SELECT * FROM reviews",
    "doc_risk": f"WITH {_SCORES} SELECT CASE WHEN document_score >= 70 THEN 'HIGH_RISK' WHEN document_score >= 35 THEN 'LOW_RISK' ELSE 'SAFE' END AS risk, count(*) AS n_documents, sum(n_findings)::BIGINT AS n_findings FROM reviews GROUP BY 1",
    "policy_decision": f"""WITH {_FOUND},
      r AS (SELECT *, CASE WHEN severity = 'high' AND category = 'MNPI' THEN 4 WHEN severity = 'high' THEN 2 ELSE 1 END AS rank FROM found),
      b AS (SELECT doc_id, max(rank) AS rank, string_agg(DISTINCT CASE rank WHEN 4 THEN 'hold_until_public' WHEN 2 THEN 'redact_pii' ELSE 'review' END, ',' ORDER BY CASE rank WHEN 4 THEN 'hold_until_public' WHEN 2 THEN 'redact_pii' ELSE 'review' END) AS actions,
        string_agg(DISTINCT rule, ',' ORDER BY rule) FILTER (rank >= 2) AS blocking_rules FROM r GROUP BY doc_id),
      d AS (SELECT doc_id, greatest(coalesce(rank, 0), CASE WHEN lang <> 'en' THEN 1 ELSE 0 END) AS rank, coalesce(actions, '') AS actions, coalesce(blocking_rules, '') AS blocking_rules FROM documents LEFT JOIN b USING (doc_id))
      SELECT doc_id, ['allow', 'warn', 'rewrite_required', 'approval_required', 'block'][rank + 1] AS decision, rank <= 1 AS send_allowed, actions, blocking_rules FROM d""",
    "lane_partition": f"""WITH {_SCORES} SELECT f.doc_id, rule, start_char, CASE severity WHEN 'high' THEN 'always_visible' WHEN 'medium' THEN 'threshold_gated' ELSE 'batched' END AS lane,
      severity = 'high' OR (severity = 'medium' AND document_score >= 60) AS visible FROM found f JOIN reviews USING (doc_id)""",
    "suggestion_actions": f"WITH {_FOUND} SELECT rule, CASE WHEN category = 'PII' THEN 'redact' WHEN severity = 'high' THEN 'remove_or_hold' ELSE 'verify_or_rewrite' END AS suggestion, count(*) AS n FROM found GROUP BY ALL",
    "pseudonymize_text": f"WITH RECURSIVE {_NUMBERED}, {_spliced('numbered')} SELECT doc_id, coalesce(n, 0)::INT AS n_replaced, sha256(coalesce(head || substr(text, upto + 1), text)) AS text_sha256 FROM documents LEFT JOIN built USING (doc_id)",
    "redact_opaque": f"WITH RECURSIVE {_NUMBERED}, {_spliced('opaque')} SELECT doc_id, coalesce(n, 0)::INT AS n_replaced, sha256(coalesce(head || substr(text, upto + 1), text)) AS text_sha256 FROM documents LEFT JOIN built USING (doc_id)",
    "mapping_store_check": f"""WITH RECURSIVE {_NUMBERED}, m AS (SELECT DISTINCT doc_id, placeholder, entity_type FROM numbered)
      SELECT (DATE '{_STORE_FROM}' + (doc_id % {_STORE_DAYS})::INT)::DATE AS stored_on, entity_type, count(*) AS n_stored, count(*) AS n_opened, 0::BIGINT AS n_clear, 0::BIGINT AS n_other_key, 0::BIGINT AS n_moved,
        count(*) FILTER (doc_id % {_STORE_DAYS} >= {_STORE_DAYS // 2}) AS n_kept FROM m GROUP BY ALL""",
    "pseudonym_mapping": f"WITH RECURSIVE {_NUMBERED} SELECT doc_id, placeholder, entity_type, arg_min(matched_text, start_char) AS original_text, count(*) AS occurrence_count FROM numbered GROUP BY ALL",
    "reidentify_roundtrip": "SELECT doc_id, true AS restored FROM documents",
    "safe_rewrite_plan": f"""WITH RECURSIVE {_ACCEPTED} SELECT f.doc_id, f.rule, f.start_char, f.end_char,
      CASE WHEN a.doc_id IS NULL THEN 'overlap' WHEN f.severity = 'low' THEN 'low_severity' END AS skip_reason,
      CASE WHEN a.doc_id IS NOT NULL AND f.severity <> 'low' THEN '[REDACTED PERSONAL DATA]' END AS replacement
      FROM found f LEFT JOIN accepted a ON a.doc_id = f.doc_id AND a.rule = f.rule AND a.start_char = f.start_char""",
    "structure_units": f"WITH {_UNITS} SELECT doc_id, line_no, kind, start_char, start_char + size::INT AS end_char, sum(brk) OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS island FROM units",
    "structure_parent_heading": f"WITH {_UNITS} SELECT doc_id, line_no, parent_line FROM units WHERE parent_line IS NOT NULL",
    "smallest_unit": f"""WITH {_UNITS}, f AS ({oracle.spans(rules.IDENTIFIERS)}) SELECT f.doc_id, rule, f.start_char, line_no AS unit_id
      FROM f JOIN units u ON u.doc_id = f.doc_id AND u.start_char <= f.start_char AND f.end_char <= u.start_char + size""",
    "defined_terms_session": r"""
WITH t AS (SELECT conv_id, turn, list_distinct(list_transform(
    regexp_extract_all(coalesce(text, ''), '"([A-Z][A-Za-z ]+)" means', 1) || regexp_extract_all(coalesce(text, ''), '\((?:the )?"([A-Z][A-Za-z ]+)"\)', 1) || regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{4,}'), lambda x: lower(x))) AS terms FROM conversations)
SELECT conv_id, turn, len(terms)::INT AS n_terms,
  len(list_distinct(flatten(coalesce(list(terms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []))))::INT AS n_known FROM t""",
}
