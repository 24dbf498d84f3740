"""Queries over generated memos: rules of which the documents hold nothing. The text is made from orders (see sources.carrier)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import rules
from docsieve.functions import text as T
from docsieve.operators import joins, mnpi, reident, scoring, spans
from docsieve.plans import oracle
from docsieve.sources import carrier

_RULES = [*rules.FIELD_IDENTIFIERS, *rules.PERSONS, *rules.MNPI, *rules.PROXIMITY]
_TERMS = [r for r in rules.MNPI if r.name in ("total_contract_value", "contract_discount_rate", "financial_amount", "financial_percentage")]
_DEAL = [*rules.PERSONS, *rules.MNPI, *rules.PROXIMITY]
_CHECKED = [r for r in rules.FIELD_IDENTIFIERS if r.check]
_QUASI = [*rules.FIELD_IDENTIFIERS, *rules.PERSONS, rules.IDENTIFIERS[2]]


def carrier_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.find(carrier.memos(spark, sf_dir), _RULES).groupBy("rule", "severity").agg(F.count("*").alias("n"), F.sum("start_char").alias("starts"), F.countDistinct("matched_text").alias("n_texts"))


def ctx_back25_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = carrier.memos(spark, sf_dir)
    found = spans.find(docs, rules.MNPI[:1], guarded=False).join(docs.select("doc_id", "text"), "doc_id")
    negated = T.back(F.col("text"), F.col("start_char"), 25).rlike("(?i)not[ \t]*$")
    return found.select("doc_id", "rule", "start_char", negated.alias("negated"))


def cooccur_semijoin_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.amplified(spans.find(carrier.memos(spark, sf_dir), _DEAL), [r.name for r in rules.PROXIMITY], rules.TRIGGERS)
    return found.where(F.col("rule").isin([r.name for r in rules.PROXIMITY])).select("doc_id", "rule", "start_char", "severity", "score")


def linked_id_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.linked(spans.find(carrier.memos(spark, sf_dir), [*rules.FIELD_IDENTIFIERS, *rules.PERSONS]), rules.LINKED_IDS)
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"))


def jurisdiction_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.find(carrier.memos(spark, sf_dir), rules.FIELD_IDENTIFIERS)
    return found.withColumn("jurisdiction", scoring.attribution(["SG", "US", "AU"])).groupBy("rule", "jurisdiction").agg(F.count("*").alias("n"))


def carrier_codename_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = carrier.memos(spark, sf_dir)
    return mnpi.overridden(spans.find(docs, rules.MNPI[:5]), docs).select("doc_id", "rule", "document_type", "start_char", "severity")


def carrier_material_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mnpi.material_events(carrier.memos(spark, sf_dir))


def carrier_contract_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.find(carrier.memos(spark, sf_dir), _TERMS).select("doc_id", "rule", "start_char", "end_char", "matched_text")


def carrier_materiality_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = carrier.memos(spark, sf_dir)
    amount = spans.find(docs, [r for r in rules.MNPI if r.name == "total_contract_value"]).join(docs.select("doc_id", "o_custkey"), "doc_id")
    size = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), (F.abs("c_acctbal") * 1000).alias("size"))
    value = F.regexp_replace("matched_text", "[^0-9]", "").cast("double")
    return amount.join(size, "o_custkey").select("doc_id", mnpi.materiality(value, F.col("size"), "US", F.lit("low")).alias("severity_us"), mnpi.materiality(value, F.col("size"), "AU", F.col("severity")).alias("severity_au"))


def carrier_blackout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = carrier.memos(spark, sf_dir)
    date = F.try_to_date(F.regexp_extract("text", " on ([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")
    quarter = F.to_date(F.add_months(F.trunc(date, "quarter"), 3))
    return docs.select("doc_id", date.alias("document_date"), quarter.alias("announcement_date")).where(mnpi.in_blackout(F.col("document_date"), F.col("announcement_date")))


def carrier_conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mnpi.conjunction(spans.find(carrier.memos(spark, sf_dir), _DEAL))


def carrier_quasi_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reident.seeds(spans.find(carrier.memos(spark, sf_dir), _QUASI))


def carrier_k_anonymity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = carrier.memos(spark, sf_dir)
    nations = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").agg(F.count("*").alias("population"))
    homes = spark.read.parquet(f"{sf_dir}/customer.parquet").join(nations, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "population")
    weighted = reident.weights(spans.find(docs, _QUASI)).join(docs.select("doc_id", "o_custkey"), "doc_id").join(homes, "o_custkey")
    return reident.k_anonymity(weighted, "population").select("doc_id", "weight", "k", "severity", "probability")


def carrier_checksum_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.find(carrier.memos(spark, sf_dir), _CHECKED).select("doc_id", "rule", "start_char", "matched_text")


_MEMOS = f"memos AS ({carrier.SQL})"
_OF = lambda rs, guarded=True: oracle.spans(rs, "memos", guarded=guarded)
_names = lambda rs: ", ".join(oracle.quoted(x) for x in rs)
_HIDDEN = next(r.expression for r in rules.MNPI if r.name == "nonpublic_marker")
_OVERRIDES = ", ".join(f"('{r}', '{t}', '{s}')" for (r, t), s in rules.SEVERITY_OVERRIDES.items())


def _ladder(jurisdiction: str, severity: str) -> str:
    medium, high = mnpi.LADDERS[jurisdiction]
    return f"CASE WHEN v / nullif(size, 0) >= {high} THEN 'high' WHEN v / nullif(size, 0) >= {medium} AND {severity} = 'low' THEN 'medium' ELSE {severity} END"


_W = "CASE rule " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in reident.WEIGHTS.items()) + " ELSE 0::DOUBLE END"
QUERIES = {
    f.__name__: f
    for f in (carrier_spans, ctx_back25_negation, cooccur_semijoin_200, linked_id_window, jurisdiction_attribution, carrier_codename_severity, carrier_material_event, carrier_contract_terms, carrier_materiality_ladder, carrier_blackout, carrier_conjunctive, carrier_quasi_seed, carrier_k_anonymity, carrier_checksum_ids)
}
ORACLE_SQL = {
    "carrier_spans": f"WITH {_MEMOS}, f AS ({_OF(_RULES)}) SELECT rule, severity, count(*) AS n, sum(start_char)::BIGINT AS starts, count(DISTINCT matched_text) AS n_texts FROM f GROUP BY ALL",
    "ctx_back25_negation": f"WITH {_MEMOS}, f AS ({_OF(rules.MNPI[:1], False)}) SELECT doc_id, rule, start_char, regexp_matches(substr(text, greatest(start_char - 25, 0) + 1, start_char - greatest(start_char - 25, 0)), '(?i)not[ \\t]*$') AS negated FROM f JOIN memos USING (doc_id)",
    "cooccur_semijoin_200": f"""WITH {_MEMOS}, f AS ({_OF(_DEAL)}),
      t AS (SELECT *, EXISTS (SELECT 1 FROM f o WHERE o.doc_id = p.doc_id AND o.rule IN ({_names(rules.TRIGGERS)}) AND o.end_char >= greatest(p.start_char - 200, 0) AND o.start_char <= p.end_char + 200) AS near
            FROM f p WHERE rule IN ({_names(r.name for r in rules.PROXIMITY)}))
      SELECT doc_id, rule, start_char, CASE WHEN near AND severity = 'low' THEN 'medium' ELSE severity END AS severity, CASE WHEN near AND severity = 'low' THEN 55 ELSE score END::DOUBLE AS score FROM t""",
    "linked_id_window": f"""WITH {_MEMOS}, f AS ({_OF([*rules.FIELD_IDENTIFIERS, *rules.PERSONS])}),
      n AS (SELECT DISTINCT doc_id FROM f WHERE rule = 'named_person')
      SELECT rule, CASE WHEN severity = 'medium' AND rule IN ({_names(rules.LINKED_IDS)}) AND doc_id IN (SELECT doc_id FROM n) THEN 'high' ELSE severity END AS severity, count(*) AS n FROM f GROUP BY ALL""",
    "jurisdiction_attribution": f"WITH {_MEMOS}, f AS ({_OF(rules.FIELD_IDENTIFIERS)}) SELECT rule, CASE WHEN upper(split_part(rule, '_', 1)) IN ('SG', 'US', 'AU') THEN upper(split_part(rule, '_', 1)) ELSE 'SG+US+AU' END AS jurisdiction, count(*) AS n FROM f GROUP BY ALL",
    "carrier_codename_severity": f"""WITH {_MEMOS}, f AS ({_OF(rules.MNPI[:5])}), o(rule, document_type, override) AS (VALUES {_OVERRIDES})
      SELECT doc_id, rule, document_type, start_char, coalesce(override, severity) AS severity FROM f JOIN memos USING (doc_id) LEFT JOIN o USING (rule, document_type)""",
    "carrier_material_event": f"""WITH {_MEMOS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM memos),
      h AS (SELECT *, len(regexp_extract_all(line, {oracle.quoted(rules.EVENT_WORDS)})) AS hits FROM l WHERE NOT regexp_matches(line, {oracle.quoted(rules.EVENT_NEGATED)}))
      SELECT doc_id, line_no::INT AS line_no, unnest(range(1, hits + 1))::INT AS n_hit,
        CASE WHEN regexp_matches(line, {oracle.quoted(_HIDDEN)}) THEN 'high' WHEN regexp_matches(line, {oracle.quoted(rules.EVENT_PUBLIC)}) THEN 'low' ELSE 'medium' END AS severity,
        regexp_matches(line, {oracle.quoted(rules.EVENT_PUBLIC)}) AS public FROM h WHERE hits > 0""",
    "carrier_contract_terms": f"WITH {_MEMOS}, f AS ({_OF(_TERMS)}) SELECT doc_id, rule, start_char, end_char, matched_text FROM f",
    "carrier_materiality_ladder": f"""WITH {_MEMOS}, f AS ({_OF([r for r in rules.MNPI if r.name == 'total_contract_value'])}),
      x AS (SELECT f.doc_id, regexp_replace(matched_text, '[^0-9]', '', 'g')::DOUBLE AS v, abs(c_acctbal) * 1000 AS size FROM f JOIN memos USING (doc_id) JOIN customer ON c_custkey = o_custkey)
      SELECT doc_id, {_ladder('US', "'low'")} AS severity_us, {_ladder('AU', "'medium'")} AS severity_au FROM x""",
    "carrier_blackout": f"""WITH {_MEMOS}, d AS (SELECT doc_id, o_orderdate::DATE AS document_date, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::DATE AS announcement_date FROM memos)
      SELECT * FROM d WHERE announcement_date - document_date BETWEEN 0 AND {mnpi.BLACKOUT_DAYS}""",
    "carrier_conjunctive": f"""WITH {_MEMOS}, f AS ({_OF(_DEAL)}),
      g AS (SELECT doc_id, bool_or(rule IN ('named_person', 'transaction_codename')) AS entity, bool_or(category = 'MNPI' AND rule <> 'transaction_codename') AS hidden,
        CASE WHEN bool_or(rule IN ('definitive_agreement', 'material_adverse_change')) THEN 'lexicalised' WHEN bool_or(rule IN ('total_contract_value', 'financial_amount', 'financial_percentage')) THEN 'quantitative'
             WHEN bool_or(rule = 'contingent_mnpi_language') THEN 'implied' ELSE 'undetermined' END AS state,
        bool_or(rule IN ('insider_list_marker', 'tipping_language')) AS duty, min(start_char) AS start_char, max(end_char) AS end_char FROM f GROUP BY doc_id)
      SELECT doc_id, state, CASE WHEN duty AND state <> 'undetermined' THEN 'high' ELSE 'medium' END AS severity, start_char, end_char FROM g WHERE entity AND hidden""",
    "carrier_k_anonymity": f"""WITH {_MEMOS}, f AS ({_OF(_QUASI)}), p AS (SELECT c_nationkey, count(*) AS population FROM customer GROUP BY 1),
      r AS (SELECT doc_id, rule, max({_W}) AS w FROM f GROUP BY ALL),
      g AS (SELECT doc_id, round(sum(w), 6) AS weight, bool_or(rule IN ({_names(reident.DIRECT)})) AS direct FROM r GROUP BY doc_id),
      x AS (SELECT g.*, population, CASE WHEN weight >= 2.2 THEN 1 WHEN weight >= 1.8 THEN 3 ELSE 10 END AS bound FROM g JOIN memos USING (doc_id) JOIN customer ON c_custkey = o_custkey JOIN p USING (c_nationkey)),
      k AS (SELECT *, (CASE WHEN direct THEN 1 WHEN population < 20 THEN population WHEN weight >= 1.4 THEN least(population, bound) ELSE population END)::BIGINT AS k FROM x)
      SELECT doc_id, weight, k, CASE WHEN k < 2 THEN 'high' WHEN k < 5 THEN 'medium' ELSE 'low' END AS severity, round(1 / greatest(k, 1)::DOUBLE, 6) AS probability FROM k""",
    "carrier_checksum_ids": f"WITH {_MEMOS}, f AS ({_OF(_CHECKED)}) SELECT doc_id, rule, start_char, matched_text FROM f",
}
