"""Generated text: orders rendered as briefings that name issuers, which are the customers, in several ways and now and then only nearly; and the issuers' calendar of announcements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.sources import tables

_A = ["Northern", "Golden", "Pacific", "Summit", "Harbour", "Crescent", "Silver", "Imperial", "Unity", "Atlas", "Delta"]
_B = ["Shipping", "Foods", "Energy", "Textile", "Mining", "Robotics", "Biotech", "Rail", "Timber", "Glass", "Paper", "Marine", "Steel"]
_C = ["Holdings", "Group", "Ventures", "Works", "Trading", "Systems", "Partners"]
_END = ["Ltd", "Pte Ltd", "Inc", "PLC", "Limited"]


def _of(words: list[str], key: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(words))
    return f"CASE {key} % {len(words)} {cases} END"


def name(key: str) -> str:
    """SQL for an issuer's name; its number makes it its own."""
    n = f"CAST({key} AS BIGINT)"
    return f"concat({_of(_A, n)}, ' ', {_of(_B, n)}, ' ', {_of(_C, n)}, ' ', CAST({n} AS STRING), ' ', {_of(_END, n)})"


_KEY = "CAST(o_orderkey AS BIGINT)"
_WHO = f"CASE {_KEY} % 5 WHEN 0 THEN upper({name('o_custkey')}) WHEN 1 THEN replace({name('o_custkey')}, ' ', ', ') WHEN 2 THEN concat({_of(_A, 'o_custkey')}, ' ', {_of(_B, 'o_custkey')}) ELSE {name('o_custkey')} END"
TEXT = f"concat('Briefing on ', {_WHO}, '. ', {_of(['We may buy shares soon', 'Please deal in its securities', 'No view on the price', 'Staff sell options', 'They sell shoes'], _KEY)}, '; see also ', {name('o_custkey + 7')}, '.')"
SQL = f"SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS document_date, {TEXT} AS text FROM orders"
ISSUERS_SQL = f"SELECT CAST(c_custkey AS BIGINT) AS issuer_id, {name('c_custkey')} AS name FROM customer"
#: Announcements: each quarter of these years, on a day that depends on the issuer.
YEARS = (1992, 2002)


def briefings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, document_date, text): one briefing an order."""
    return tables.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").selectExpr("o_orderkey AS doc_id", "CAST(o_orderdate AS DATE) AS document_date", f"{TEXT} AS text")


def issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "customer", "c_custkey").selectExpr("CAST(c_custkey AS BIGINT) AS issuer_id", f"{name('c_custkey')} AS name")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(issuer_id, announced_on)."""
    quarters = F.explode(F.sequence(F.lit(0), F.lit(4 * (YEARS[1] - YEARS[0]) - 1)))
    rows = tables.table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").cast("long").alias("issuer_id"), quarters.alias("q"))
    return rows.select("issuer_id", F.expr(f"date_add(DATE '{YEARS[0]}-01-01', CAST(q * 91 + issuer_id * 37 % 89 AS INT))").alias("announced_on"))


CALENDAR_SQL = f"SELECT CAST(c_custkey AS BIGINT) AS issuer_id, (DATE '{YEARS[0]}-01-01' + (q * 91 + c_custkey * 37 % 89)::INT)::DATE AS announced_on FROM customer, (SELECT unnest(range({4 * (YEARS[1] - YEARS[0])})) AS q)"
