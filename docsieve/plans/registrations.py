"""Queries of the jurisdiction packs over registration sheets (see sources.registrations), with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.operators import fields
from docsieve.plans import oracle
from docsieve.sources import registrations, rule_packs, tables

#: The packs of jurisdictions that come with the library.
PACKS = rule_packs.load()
CODES = sorted({x.pack for x in [*PACKS.fields, *PACKS.patterns]} - {"RECORDS", "SECRETS"})

_SHEETS = f"sheets AS ({registrations.SQL})"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _pack(code: str) -> None:
    own = PACKS.of(code)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fields.review(registrations.sheets(spark, sf_dir), own, id_col="c_custkey")

    QUERIES[f"pack_{code.lower()}"] = query
    ORACLE_SQL[f"pack_{code.lower()}"] = f"WITH {_SHEETS} {oracle.packs(own, 'sheets', 'c_custkey')}"


for _code in CODES:
    _pack(_code)


def pack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each pack finds, all rules of all packs in one review."""
    found = fields.review(registrations.sheets(spark, sf_dir), PACKS.of(*CODES), id_col="c_custkey")
    pack = F.upper(F.substring("rule", 1, 2))
    return found.groupBy(pack.alias("pack"), "rule", "severity").agg(F.count("*").alias("n_findings"), F.countDistinct("c_custkey").alias("n_customers"))


QUERIES["pack_summary"] = pack_summary
ORACLE_SQL["pack_summary"] = f"WITH {_SHEETS}, f AS ({oracle.packs(PACKS.of(*CODES), 'sheets', 'c_custkey')}) SELECT upper(rule[1:2]) AS pack, rule, severity, count(*) AS n_findings, count(DISTINCT c_custkey) AS n_customers FROM f GROUP BY ALL"


def secret_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values near the keywords of the packs' secret rules, over all documents."""
    return fields.secrets(tables.table(spark, sf_dir, "documents", "doc_id", "text"), PACKS.secrets)


QUERIES["secret_rules"] = secret_rules
ORACLE_SQL["secret_rules"] = f"WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) {oracle.secrets(PACKS.secrets, 'docs')}"
