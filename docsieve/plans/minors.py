"""The query of minors over notes that fall under several jurisdictions each, with its SQL: a join of ages with the cliffs of each note's packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import ages
from docsieve.functions.rules import Rule
from docsieve.operators import minors
from docsieve.plans import oracle
from docsieve.sources import letters


def minor_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference to a minor, with the jurisdictions that it triggers."""
    return minors.find(letters.youth(spark, sf_dir), F.col("packs"))


def _sql() -> str:
    q = oracle.quoted
    years = dict(ages.GRADES)
    parts = []
    for k, (pattern, grade) in enumerate(ages.TOLD):
        before = f" AND NOT regexp_matches(substr(text, greatest(start_char - {ages.BEFORE}, 0) + 1, start_char - greatest(start_char - {ages.BEFORE}, 0)), {q(ages.NOT_BEFORE)})" if grade == "grade" else ""
        explicit = f" AND regexp_extract(matched_text, '[0-9]+')::INT <= {ages.MOST_AGE}" if not grade else ""
        parts.append(f"""SELECT doc_id, start_char, end_char, matched_text, regexp_extract(matched_text, '[0-9]+')::INT + {years.get(grade, 0)} AS age
        FROM ({oracle.spans([Rule(f'r{k}', 'PII', 'low', pattern)], 'notes')}) JOIN notes USING (doc_id)
        WHERE NOT regexp_matches(substr(text, end_char + 1, {ages.AFTER}), {q(ages.NOT_AFTER)}){before}{explicit}""")
    parts.append(f"""SELECT doc_id, s::INT, e::INT, phrase, NULL::INT FROM ({oracle.hits('notes', ages.PHRASES)}) WHERE NOT regexp_matches(substr(text, e + 1, {ages.AFTER}), {q(ages.NOT_AFTER)})""")
    cliffs = ", ".join(f"({k}, '{p}', {c})" for k, (p, c) in enumerate(ages.CLIFFS.items()))
    return f"""WITH notes AS MATERIALIZED ({letters.YOUTH_SQL}), cliffs(k, pack, cliff) AS (VALUES {cliffs}),
      known AS (SELECT doc_id, list_filter(packs, lambda p: p IN ({', '.join(f"'{p}'" for p in ages.CLIFFS)})) AS ps FROM notes),
      own AS (SELECT doc_id, k, c.pack, cliff, min(cliff) OVER (PARTITION BY doc_id) AS lowest FROM known JOIN cliffs c ON list_contains(CASE WHEN len(ps) = 0 THEN ['SG'] ELSE ps END, c.pack)),
      f AS (SELECT row_number() OVER () AS r, * FROM ({' UNION ALL '.join(parts)}))
      SELECT any_value(f.doc_id) AS doc_id, 'minor_data_reference' AS rule, CASE WHEN any_value(age) IS NULL OR any_value(age) < any_value(lowest) THEN 'high' ELSE 'medium' END AS severity, any_value(age) AS age,
        string_agg(pack, '+' ORDER BY k) AS triggered, any_value(start_char) AS start_char, any_value(end_char) AS end_char, any_value(matched_text) AS matched_text
      FROM f JOIN own USING (doc_id) WHERE age IS NULL OR age < cliff GROUP BY r"""


QUERIES = {"minor_references": minor_references}
ORACLE_SQL = {"minor_references": _sql()}
