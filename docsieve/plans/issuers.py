"""Queries of issuers named in briefings and of blackouts by their calendar, with their SQL: every name against every text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.operators import issuers
from docsieve.plans import oracle
from docsieve.sources import briefings


def issuer_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions by issuer: documents that hold its whole name."""
    found = issuers.mentioned(briefings.briefings(spark, sf_dir), briefings.issuers(spark, sf_dir))
    return found.groupBy("issuer_id").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc"))


def issuer_blackouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Briefings within the closed days before an announcement of an issuer that they name."""
    return issuers.blackouts(briefings.briefings(spark, sf_dir), briefings.issuers(spark, sf_dir), briefings.calendar(spark, sf_dir))


_ENDINGS = "|".join(issuers.ENDINGS)
_FLAT = lambda x: f"' ' || array_to_string(regexp_extract_all(lower({x}), '{issuers.TOKEN}'), ' ') || ' '"
_BASE = f"""docs AS MATERIALIZED (SELECT *, {_FLAT('text')} AS flat FROM ({briefings.SQL})),
  names AS MATERIALIZED (SELECT issuer_id, regexp_replace({_FLAT('name')}, '( ({_ENDINGS}))+ $', ' ') AS phrase FROM ({briefings.ISSUERS_SQL})),
  m AS MATERIALIZED (SELECT doc_id, issuer_id, document_date, text FROM docs JOIN names ON contains(flat, phrase))"""
QUERIES = {f.__name__: f for f in (issuer_mentions, issuer_blackouts)}
ORACLE_SQL = {
    "issuer_mentions": f"WITH {_BASE} SELECT issuer_id, count(*) AS n_documents, min(doc_id) AS first_doc FROM m GROUP BY ALL",
    "issuer_blackouts": f"""WITH {_BASE}, c AS ({briefings.CALENDAR_SQL})
      SELECT *, datediff('day', document_date, announced_on)::INT AS days_left FROM (
        SELECT doc_id, issuer_id, document_date, min(announced_on) AS announced_on, regexp_matches(text, {oracle.quoted(issuers.INTENT)}) AS intent
        FROM m JOIN c USING (issuer_id) WHERE announced_on BETWEEN document_date AND document_date + {issuers.CLOSED_DAYS} GROUP BY doc_id, issuer_id, document_date, text)""",
}
