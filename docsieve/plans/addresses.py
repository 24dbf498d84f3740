"""Queries of postal addresses over letters, with their SQL: candidates phase by phase, then a fold over each letter's candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import places
from docsieve.functions.rules import Rule
from docsieve.operators import addresses
from docsieve.plans import oracle
from docsieve.sources import letters


def address_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address of every letter, with the phase that found it."""
    return addresses.find(letters.letters(spark, sf_dir))


def address_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses by rule and phase where only the packs of Britain, the United States and Malaysia are on: what the others' shapes would have taken falls to later phases."""
    found = addresses.find(letters.letters(spark, sf_dir), ["UK", "US", "MY"])
    return found.groupBy("rule", "phase").agg(F.count("*").alias("n_findings"), F.countDistinct("doc_id").alias("n_documents"), F.sum(F.col("end_char") - F.col("start_char")).cast("long").alias("n_chars"))


_q = oracle.quoted
_like = lambda x, p: f"regexp_matches({x}, {_q(p)})"


def _substance(x: str) -> str:
    return f"""({_like(x, '[0-9]')} AND (({_like(x, places.WORDS_OF_ADDRESS)} AND ({_like(x, places.POSTCODE)} OR {_like(x, places.LOCALITY)} OR {_like(x, places.REGION)}))
        OR ({_like(x, places.POSTCODE)} AND {_like(x, places.LOCALITY)})))"""


def _organisation(x: str) -> str:
    return f"({_like(x, places.ORGANISATION)} AND NOT {_like(x, places.PERSON_LINKED)})"


def _cleaned(source: str) -> str:
    """Rows (doc_id, s, v) without blanks around v, nor points and semicolons behind it."""
    return f"SELECT * REPLACE (s + length(v) - length(ltrim(v, ' ' || chr(9) || chr(10) || chr(13))) AS s, rtrim(ltrim(v, ' ' || chr(9) || chr(10) || chr(13)), ' .;' || chr(9) || chr(10) || chr(13)) AS v) FROM ({source})"


def _found(shapes: list[places.Shape]) -> str:
    rules = [Rule(s.rule, "PII", "medium", s.pattern) for s in shapes]
    order = " ".join(f"WHEN '{s.rule}' THEN {k}" for k, s in enumerate(places.SHAPES))
    late = ", ".join(f"'{s.rule}'" for s in shapes if s.late)
    spans_of = lambda r: oracle.spans([r], "docs")
    return f"""
docs AS MATERIALIZED ({letters.SQL}),
country AS (
  SELECT doc_id, CASE WHEN rule IN ({late}) THEN 5 ELSE 1 END AS phase, CASE rule {order} END AS ord, rule, start_char AS s, matched_text AS v
  FROM ({oracle.spans(rules, 'docs')}) JOIN docs USING (doc_id)
  WHERE NOT {_organisation("regexp_extract(substr(text, 1, start_char), '[^\\n]*$') || matched_text || regexp_extract(substr(text, end_char + 1), '^[^\\n]*')")}),
fields AS (
  SELECT doc_id, start_char AS s, matched_text AS v, substr(text, end_char + 1) AS rest FROM ({spans_of(Rule('f', 'PII', 'medium', places.LABELLED, cap=True))}) JOIN docs USING (doc_id)),
lines AS (
  SELECT doc_id, start_char AS s, matched_text AS v, substr(text, end_char + 1) AS rest
  FROM ({spans_of(Rule('l', 'PII', 'medium', addresses._LINE))}) JOIN docs USING (doc_id) WHERE {_like('matched_text', places.PERSON_LINKED)}),
one AS (
  SELECT 2 AS phase, *, regexp_extract(rest, '^\\n[^\\n]{{6,160}}') AS a FROM fields UNION ALL
  SELECT 4, *, regexp_extract(rest, '^\\n[^\\n]*[^\\n \\t\\r][^\\n]*') FROM lines),
two AS (SELECT *, regexp_extract(substr(rest, length(a) + 1), CASE phase WHEN 2 THEN '^\\n[^\\n]{{6,160}}' ELSE '^\\n[^\\n]*[^\\n \\t\\r][^\\n]*' END) AS b FROM one),
longer AS (
  SELECT phase, doc_id, s, v || CASE WHEN a = '' OR {_like('substr(a, 2)', places.FIELD_LINE)} THEN '' WHEN b = '' OR {_like('substr(b, 2)', places.FIELD_LINE)} THEN a ELSE a || b END AS v FROM two),
windows AS ({_cleaned('SELECT * FROM longer')}),
tails AS ({_cleaned("SELECT doc_id, s AS begin, s + length(v) AS stop, s + length(v) - length(regexp_replace(v, '^[^\\n]*\\n?', '')) AS s, regexp_replace(v, '^[^\\n]*\\n?', '') AS v, v AS whole FROM windows WHERE phase = 4")}),
narrowed AS (
  SELECT doc_id, begin, stop, CASE WHEN u THEN s ELSE begin END AS s, CASE WHEN u THEN v ELSE whole END AS v
  FROM (SELECT *, NOT {_substance("string_split(whole, chr(10))[1]")} AND {_substance('v')} AS u FROM tails)),
freeform AS ({_cleaned(f"SELECT doc_id, start_char AS s, matched_text AS v FROM ({spans_of(Rule('p', 'PII', 'medium', places.FREEFORM, cap=True))})")}),
candidates AS (
  SELECT doc_id, phase, ord, rule, s AS begin, s + length(v) AS stop, s, v FROM country
  UNION ALL SELECT doc_id, 2, 0, 'postal_address', s, s + length(v), s, v FROM windows WHERE phase = 2 AND {_substance('v')}
  UNION ALL SELECT doc_id, 3, 0, 'postal_address', s, s + length(v), s, v FROM freeform WHERE {_substance('v')} AND NOT {_organisation('v')}
  UNION ALL SELECT doc_id, 4, 0, 'postal_address', begin, stop, s, v FROM narrowed
    WHERE (NOT contains(v, chr(10)) OR {_like("regexp_replace(v, '^[^\\n]*\\n', '')", '[0-9]')}) AND NOT {_organisation('v')} AND {_substance('v')}),
listed AS (
  SELECT doc_id, list({{'phase': phase, 'rule': rule, 'a': begin::BIGINT, 'b': stop::BIGINT, 's': s::BIGINT, 'e': (s + length(v))::BIGINT, 'v': v}} ORDER BY phase, ord, begin) AS cs FROM candidates GROUP BY doc_id),
kept AS (
  SELECT doc_id, unnest(list_reduce(list_prepend([cs[1]], list_transform(cs[2:], lambda c: [c])),
    lambda u, c: CASE WHEN c[1].phase > 1 AND (c[1].a >= c[1].b OR len(list_filter(u, lambda k: k.s < c[1].b AND c[1].a < k.e)) > 0) THEN u ELSE list_concat(u, c) END)) AS x FROM listed),
found AS (
  SELECT doc_id, x.rule AS rule, [{', '.join(f"'{p}'" for p in addresses.PHASES)}][x.phase] AS phase, x.s::INT AS start_char, x.e::INT AS end_char, x.v AS matched_text FROM kept)"""


QUERIES = {f.__name__: f for f in (address_phases, address_packs)}
ORACLE_SQL = {
    "address_phases": f"WITH {_found(places.SHAPES)} SELECT * FROM found",
    "address_packs": f"""WITH {_found([s for s in places.SHAPES if s.pack in ('UK', 'US', 'MY')])}
      SELECT rule, phase, count(*) AS n_findings, count(DISTINCT doc_id) AS n_documents, sum(end_char - start_char)::BIGINT AS n_chars FROM found GROUP BY ALL""",
}
