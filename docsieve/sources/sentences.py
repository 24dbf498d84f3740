"""Generated text with known truth: for each customer and each marker one sentence with one of its phrases, in a quarter of the cases behind a negation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import rules
from docsieve.sources import tables

#: Rules with phrases, as they are planted.
PLANTED = [r for r in [*rules.PRIVACY_EVENTS, *rules.MNPI, *rules.PROXIMITY] if r.phrases]
#: Phrases of a rule that are used; they are spread over its list.
_USED = 12
_OWN = [r.phrases[:: max(1, len(r.phrases) // _USED)] for r in PLANTED]
_KEY = "CAST(c_custkey AS BIGINT)"
#: Whether a sentence is behind a negation, and which of its rule's phrases it has, as SQL over c_custkey, k and n (how many phrases).
_NEGATED, _PICKED = f"({_KEY} * (6101 * (k + 5)) + k) % 1000003 % 4 = 0", f"CAST(({_KEY} * (7919 * (k + 3)) + k) % 1000003 % n AS INT)"
_TEXT = f"concat(CASE WHEN {_NEGATED} THEN 'We found no ' ELSE 'We speak of ' END, phrase, ' here.')"
_LISTS = ", ".join("[" + ", ".join("'" + p.replace("'", "''") + "'" for p in own) + "]" for own in _OWN)
SQL = f"""SELECT {_KEY} * 100 + k AS doc_id, k, {_TEXT} AS text, {_NEGATED} AS negated
  FROM (SELECT *, own[{_PICKED} + 1] AS phrase FROM (SELECT *, len(own) AS n FROM (SELECT c_custkey, unnest([{_LISTS}]) AS own, unnest(range({len(_OWN)}))::INT AS k FROM customer)))"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, k, text, negated): k is the rule's number in PLANTED."""
    lists = F.array(*(F.array(*map(F.lit, own)) for own in _OWN))
    rows = tables.table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.posexplode(lists).alias("k", "own")).withColumn("n", F.size("own"))
    return rows.withColumn("phrase", F.expr(f"own[{_PICKED}]")).selectExpr(f"{_KEY} * 100 + k AS doc_id", "k", f"{_TEXT} AS text", f"{_NEGATED} AS negated")
