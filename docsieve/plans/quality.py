"""Queries on detector quality, similarity and pages, with their SQL.

Labels stand in for reviewed ones: the unguarded findings of documents whose id isn't divisible by 7, some with another text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import rules
from docsieve.operators import evaluation, journal, scoring, similarity, spans
from docsieve.plans import audit, documents, oracle
from docsieve.sources import html, tables

_THRESHOLDS = [10, 25, 40, 55, 70, 85]
#: Least documents of each source and language that coverage asks for.
_MINIMA = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.table(spark, sf_dir, name)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = spans.find(docs, rules.IDENTIFIERS, guarded=False).where("doc_id % 7 <> 0").withColumn("matched_text", F.when(F.col("doc_id") % 5 == 0, F.concat("matched_text", F.lit("!"))).otherwise(F.col("matched_text")))
    return evaluation.outcomes(documents._found(spark, sf_dir), labels)


def recall_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.by_rule(_outcomes(spark, sf_dir)).select("rule", "matched", "missed", "recall")


def corpus_f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.corpus(_outcomes(spark, sf_dir))


def miss_concentration_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.miss_cells(_outcomes(spark, sf_dir), _table(spark, sf_dir, "documents"))


def detector_dashboard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.by_rule(_outcomes(spark, sf_dir)).orderBy(F.desc(F.col("missed") + F.col("unexpected")), "rule").limit(3)


def unexpected_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).groupBy(evaluation.triage().alias("triage")).agg(F.count("*").alias("n"))


def recall_lock_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by rule of all documents against that of the even ones, as if it had been locked."""
    rows = _outcomes(spark, sf_dir)
    return evaluation.against(evaluation.by_rule(rows), evaluation.by_rule(rows.where("doc_id % 2 = 0")), "rule", "recall")


def macro_objective_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents._docs(spark, sf_dir)
    scored = scoring.document_scores(documents._found(spark, sf_dir), docs).join(_table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("truth")), "doc_id")
    return evaluation.sweep(scored, _THRESHOLDS)


def severity_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calibration(journal.journal(_table(spark, sf_dir, "events")).where("kind = 'decision_recorded'"))


def corpus_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _table(spark, sf_dir, "documents").select(F.explode(F.array(F.concat(F.lit("lang:"), F.coalesce("lang", F.lit("?"))), F.concat(F.lit("source:"), F.coalesce("source", F.lit("?"))))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).withColumn("missing", F.greatest(F.lit(_MINIMA) - F.col("n"), F.lit(0)))


def rules_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents._found(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))


def token_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.fingerprint(_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "n_distinct", "fingerprint")


def term_hit_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.term_hits(_table(spark, sf_dir, "documents")).select("doc_id", "terms", "n_hits", "density")


def nearest_exemplar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.nearest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


def advisory_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents._docs(spark, sf_dir)
    scored = scoring.document_scores(documents._found(spark, sf_dir), docs).select("doc_id", (F.col("document_score") / 100).alias("d"))
    signals = similarity.term_hits(docs).select("doc_id", F.least(F.lit(1.0), F.col("density") / 10).alias("t")).join(scored, "doc_id")
    return signals.select("doc_id", similarity.advisory(F.col("d"), F.when(F.col("d") > 0, 0.5).otherwise(0.0), F.col("t"), F.lit(0.0)).alias("advisory"))


def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html.visible_text(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def html_hidden_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = html.hidden_values(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.size(values).alias("n_values"), F.sha2(F.array_join(values, "\n"), 256).alias("values_sha256"))


def html_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.find(html.texts(_table(spark, sf_dir, "pages")).where("part = 'hidden'"), rules.IDENTIFIERS, id_col="page_id").groupBy("rule").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (recall_by_rule, corpus_f2, miss_concentration_grouping_sets, detector_dashboard_topk, unexpected_triage, recall_lock_diff, macro_objective_sweep, severity_calibration, corpus_coverage, rules_of_document, token_fingerprint, term_hit_signal, nearest_exemplar, advisory_score, html_visible_text, html_hidden_attrs, html_findings)
}
_OUT = f"""{documents._FOUND},
labels_ AS (SELECT DISTINCT doc_id, rule, CASE WHEN doc_id % 5 = 0 THEN matched_text || '!' ELSE matched_text END AS matched_text FROM ({oracle.spans(rules.IDENTIFIERS, guarded=False)}) WHERE doc_id % 7 <> 0),
o AS (SELECT doc_id, rule, matched_text, coalesce(expected, false) AS expected, coalesce(detected, false) AS detected
  FROM (SELECT *, true AS expected FROM labels_) FULL JOIN (SELECT DISTINCT doc_id, rule, matched_text, true AS detected FROM found) USING (doc_id, rule, matched_text))"""
_COUNTS = "count(*) FILTER (expected AND detected) AS matched, count(*) FILTER (expected AND NOT detected) AS missed, count(*) FILTER (NOT expected AND detected) AS unexpected"
_RATES = "round(matched / nullif(matched + missed, 0), 4) AS recall, round(matched / nullif(matched + unexpected, 0), 4) AS precision"
_BY = f"r AS (SELECT rule, matched, missed, unexpected, {_RATES} FROM (SELECT rule, {_COUNTS} FROM o GROUP BY rule))"
_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}')"
_TERMS = ", ".join(oracle.quoted(t) for t in similarity.TERMS)
_HITS = f"h AS (SELECT doc_id, t, list_filter(t, lambda x: x IN ({_TERMS})) AS hits FROM (SELECT doc_id, {_TOKENS} AS t FROM documents))"
_DENSITY = "round(coalesce(1000 * len(hits) / nullif(len(t), 0), 0), 4)"


def _visible() -> str:
    out = f"regexp_replace(coalesce(html, ''), {oracle.quoted(html.INVISIBLE)}, ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, {oracle.quoted(html.BREAKS)}, chr(10), 'g'), '{html.TAGS}', '', 'g')"
    for entity, char in html.ENTITIES:
        out = f"replace({out}, {oracle.quoted(entity)}, {oracle.quoted(char)})"
    return f"trim(regexp_replace(regexp_replace({out}, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'))"


_VALUES = f"regexp_extract_all(coalesce(html, ''), {oracle.quoted(html.HIDDEN)}, 1)"
ORACLE_SQL = {
    "recall_by_rule": f"WITH {_OUT}, {_BY} SELECT rule, matched, missed, recall FROM r",
    "corpus_f2": f"WITH {_OUT} SELECT matched, missed, unexpected, {_RATES}, round(5.0 * matched / nullif(5.0 * matched + 4.0 * missed + unexpected, 0), 4) AS f_beta FROM (SELECT {_COUNTS} FROM o)",
    "miss_concentration_grouping_sets": f"""WITH {_OUT} SELECT rule, lang, count(*) FILTER (NOT detected) AS n_missed, count(*) AS n_expected, grouping(rule, lang)::BIGINT AS level, round(100 * count(*) FILTER (NOT detected) / count(*), 2) AS per_100
      FROM (SELECT o.*, coalesce(lang, '?') AS lang FROM o JOIN documents USING (doc_id) WHERE expected) GROUP BY GROUPING SETS ((rule, lang), (rule), (lang), ())""",
    "detector_dashboard_topk": f"WITH {_OUT}, {_BY} SELECT * FROM r ORDER BY missed + unexpected DESC, rule LIMIT 3",
    "unexpected_triage": f"""WITH {_OUT} SELECT CASE WHEN expected AND detected THEN 'matched' WHEN expected THEN 'missed' WHEN rule = 'ip_address' THEN 'weak_rule' WHEN length(matched_text) < 16 THEN 'short_text'
      WHEN regexp_matches(matched_text, '[0-9]') THEN 'has_digits' ELSE 'needs_review' END AS triage, count(*) AS n FROM o GROUP BY 1""",
    "recall_lock_diff": f"""WITH {_OUT}, {_BY}, e AS (SELECT rule, round(count(*) FILTER (expected AND detected) / nullif(count(*) FILTER (expected), 0), 4) AS recall FROM o WHERE doc_id % 2 = 0 GROUP BY rule)
      SELECT rule, r.recall AS now, e.recall AS locked, CASE WHEN e.recall IS NULL THEN 'new' WHEN r.recall IS NULL THEN 'gone' WHEN r.recall < e.recall - 1e-6 THEN 'regressed' WHEN r.recall > e.recall + 1e-6 THEN 'improved' ELSE 'same' END AS status FROM r FULL JOIN e USING (rule)""",
    "macro_objective_sweep": f"""WITH {documents._SCORES}, s AS (SELECT document_score, toxic = 1 AS truth FROM reviews JOIN labels USING (doc_id) WHERE toxic IS NOT NULL),
      g AS (SELECT threshold, count(*) FILTER (document_score >= threshold) AS flagged, count(*) FILTER (document_score >= threshold AND truth) AS hits, count(*) FILTER (truth) AS positives, count(*) AS n FROM s, (SELECT unnest({_THRESHOLDS}) AS threshold) GROUP BY threshold),
      q AS (SELECT *, coalesce(hits / nullif(flagged, 0), 0) AS p, coalesce(hits / nullif(positives, 0), 0) AS r FROM g)
      SELECT threshold, flagged, round(p, 4) AS precision, round(r, 4) AS recall, round(0.4 * p + 0.4 * r - 0.2 * flagged / n, 4) AS objective FROM q""",
    "severity_calibration": f"""WITH {audit._J}, c AS (SELECT finding_id, count(*) FILTER (action = 'accept') AS accepted, count(*) FILTER (action = 'reject') AS rejected FROM j WHERE kind = 'decision_recorded' GROUP BY 1)
      SELECT *, CASE WHEN accepted + rejected < 5 THEN 'insufficient_data' WHEN rejected / (accepted + rejected) >= 0.6 THEN 'lower_severity' WHEN rejected / (accepted + rejected) <= 0.2 THEN 'raise_severity' ELSE 'keep' END AS advice FROM c""",
    "corpus_coverage": f"SELECT tag, count(*) AS n, greatest({_MINIMA} - count(*), 0) AS missing FROM (SELECT unnest(['lang:' || coalesce(lang, '?'), 'source:' || coalesce(source, '?')]) AS tag FROM documents) GROUP BY tag",
    "rules_of_document": f"WITH {documents._FOUND} SELECT doc_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM found GROUP BY doc_id",
    "token_fingerprint": f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct, sha256(array_to_string(list_sort(list_distinct(t)), ' ')) AS fingerprint FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)",
    "term_hit_signal": f"WITH {_HITS} SELECT doc_id, array_to_string(list_sort(list_distinct(hits)), ',') AS terms, len(hits)::INT AS n_hits, {_DENSITY} AS density FROM h",
    "nearest_exemplar": f"""WITH d AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL),
      b AS (SELECT item_id, token, count(*) AS m FROM (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
      dn AS (SELECT doc_id, sum(n * n) AS n2 FROM d GROUP BY 1), bn AS (SELECT item_id, sum(m * m) AS m2 FROM b GROUP BY 1),
      p AS (SELECT doc_id, item_id, round(sum(n * m) / sqrt(any_value(n2)::DOUBLE * any_value(m2)), 6) AS similarity FROM d JOIN b USING (token) JOIN dn USING (doc_id) JOIN bn USING (item_id) GROUP BY ALL)
      SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, item_id) = 1""",
    "advisory_score": f"""WITH {documents._SCORES}, {_HITS}, x AS (SELECT doc_id, round(document_score / 100, 6)::DECIMAL(10, 6) AS d, round(least(1.0::DOUBLE, {_DENSITY} / 10), 6)::DECIMAL(10, 6) AS t FROM reviews JOIN h USING (doc_id))
      SELECT doc_id, round(100 * least(1::DECIMAL(12, 8), greatest(0::DECIMAL(12, 8), (0.55 * d + 0.20 * CASE WHEN d > 0 THEN 0.5 ELSE 0 END + 0.15 * t)::DECIMAL(12, 8))), 4)::DOUBLE AS advisory FROM x""",
    "html_visible_text": f"SELECT page_id, length(t)::INT AS n_chars, sha256(t) AS text_sha256 FROM (SELECT page_id, {_visible()} AS t FROM pages)",
    "html_hidden_attrs": f"SELECT page_id, len(v)::INT AS n_values, sha256(array_to_string(v, chr(10))) AS values_sha256 FROM (SELECT page_id, {_VALUES} AS v FROM pages)",
    "html_findings": f"WITH hidden AS (SELECT page_id, array_to_string({_VALUES}, chr(10)) AS text FROM pages), f AS ({oracle.spans(rules.IDENTIFIERS, 'hidden', key='page_id')}) SELECT rule, count(*) AS n FROM f GROUP BY 1",
}
