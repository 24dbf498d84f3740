"""Queries of persons and defined terms over agreements, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import rules
from docsieve.operators import persons, spans
from docsieve.plans import oracle
from docsieve.sources import agreements


def person_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of a person in every agreement, with the person it belongs to."""
    return persons.linked(agreements.agreements(spark, sf_dir))


def person_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons by what is known of them over all agreements: documents, mentions by kind, forms."""
    found = persons.linked(agreements.agreements(spark, sf_dir))
    kinds = [F.count_if(F.col("how") == k).alias(f"n_{k}") for k in ("honorific", "name", "surname")]
    return found.groupBy("person").agg(F.countDistinct("doc_id").alias("n_documents"), *kinds, F.countDistinct("matched_text").alias("n_forms"), F.max("severity").alias("severity"))


def defined_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each agreement's defined terms."""
    return agreements.agreements(spark, sf_dir).select("doc_id", F.explode(persons.defined_terms("text")).alias("term"))


def defined_term_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names behind an honorific that aren't a term of their document, against all of them, by rule and text."""
    docs = agreements.agreements(spark, sf_dir)
    # A document's terms travel with it, so that texts are read once and only counts are shuffled.
    held = docs.select(F.struct("doc_id", persons.defined_terms("text").alias("terms")).alias("held"), "text")
    found = spans.find(held, [rules.Rule("named_person", "PII", "low", persons.NAME)], id_col="held")
    return found.groupBy("matched_text").agg(F.count("*").alias("n_found"), F.count_if(persons.undefined(F.col("matched_text"), F.col("held.terms"))).alias("n_kept"))


_q = oracle.quoted
_TERMS = " || ".join(f"regexp_extract_all(text, {_q(p)}, 1)" for p in persons.DEFINITIONS)
_BARE = lambda x: f"trim(regexp_replace({x}, {_q(persons._HONORIFIC)}, ''))"
_BASE = f"""docs AS ({agreements.SQL}),
t AS (SELECT doc_id, document_type, text, list_distinct(list_transform({_TERMS}, lambda x: lower(trim(x)))) AS terms FROM docs),
n AS (SELECT * FROM ({oracle.spans([rules.Rule('named_person', 'PII', 'low', persons.NAME)], 'docs')}))"""
_LINKED = f"""{_BASE},
a AS (
  SELECT n.doc_id, start_char AS s, end_char AS e, matched_text AS m, {_BARE('matched_text')} AS bare, lower(trim(regexp_replace({_BARE('matched_text')}, '[\\s.,&]+', ' ', 'g'))) AS person
  FROM n JOIN t USING (doc_id) WHERE NOT list_contains(terms, lower({_BARE('matched_text')}))),
f AS (SELECT doc_id, person, arg_min(bare, s) AS bare, min(s) AS s FROM a GROUP BY ALL),
l AS (SELECT *, string_split(bare, ' ') AS parts, string_split(bare, ' ')[-1] AS last FROM f),
w AS (
  SELECT doc_id, 1 AS pass, s AS ord, bare AS word, person FROM f WHERE length(bare) >= {persons.LEAST_NAME}
  UNION ALL
  SELECT doc_id, 2, s, last, person FROM (
    SELECT l.* FROM l JOIN t USING (doc_id)
    WHERE len(parts) > 1 AND length(last) >= {persons.LEAST_SURNAME} AND lower(last) NOT IN ({', '.join(map(_q, persons.COMPANY_WORDS))}) AND NOT list_contains(terms, lower(last)) AND regexp_matches(last, '^[A-Z]')
    QUALIFY row_number() OVER (PARTITION BY doc_id, lower(last) ORDER BY s) = 1)),
h AS (
  SELECT doc_id, pass, ord, word, person, unnest(list_transform(range(1, len(ps)), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * length(word)))::BIGINT AS s, text, terms
  FROM (SELECT w.*, text, terms, string_split(text, word) AS ps FROM w JOIN t USING (doc_id))),
c AS (
  SELECT doc_id, list({{'s': s, 'e': s + length(word), 'm': word, 'how': CASE pass WHEN 1 THEN 'name' ELSE 'surname' END, 'person': person}} ORDER BY pass, ord, s) AS cs
  FROM h WHERE NOT regexp_matches(substr(text, s, CASE WHEN s > 0 THEN 1 ELSE 0 END), '\\w') AND NOT regexp_matches(substr(text, s + length(word) + 1, 1), '\\w') AND NOT list_contains(terms, lower(word))
  GROUP BY doc_id),
o AS (SELECT doc_id, list({{'s': s::BIGINT, 'e': e::BIGINT, 'm': m, 'how': 'honorific', 'person': person}} ORDER BY s) AS os FROM a GROUP BY doc_id),
k AS (
  SELECT doc_id, unnest(list_reduce(list_prepend(os, list_transform(coalesce(cs, []), lambda x: [x])),
    lambda u, x: CASE WHEN len(list_filter(u, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN u ELSE list_concat(u, x) END)) AS x
  FROM o LEFT JOIN c USING (doc_id)),
found AS (
  SELECT doc_id, 'named_person' AS rule, CASE WHEN lower(document_type) IN ({', '.join(map(_q, persons.WEIGHTY_TYPES))}) THEN 'high' ELSE 'low' END AS severity,
    x.s::INT AS start_char, x.e::INT AS end_char, x.m AS matched_text, x.how AS how, x.person AS person
  FROM k JOIN t USING (doc_id))"""

QUERIES = {f.__name__: f for f in (person_mentions, person_index, defined_terms, defined_term_suppression)}
ORACLE_SQL = {
    "person_mentions": f"WITH {_LINKED} SELECT * FROM found",
    "person_index": f"""WITH {_LINKED} SELECT person, count(DISTINCT doc_id) AS n_documents, count(*) FILTER (how = 'honorific') AS n_honorific, count(*) FILTER (how = 'name') AS n_name,
      count(*) FILTER (how = 'surname') AS n_surname, count(DISTINCT matched_text) AS n_forms, max(severity) AS severity FROM found GROUP BY ALL""",
    "defined_terms": f"WITH {_BASE} SELECT doc_id, unnest(terms) AS term FROM t",
    "defined_term_suppression": f"WITH {_BASE} SELECT matched_text, count(*) AS n_found, count(*) FILTER (NOT list_contains(terms, lower({_BARE('matched_text')}))) AS n_kept FROM n JOIN t USING (doc_id) GROUP BY ALL",
}
