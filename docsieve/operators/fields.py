"""Rules of packs over texts: values behind the names of fields, bare patterns, and secrets near their keywords.

The names of all fields, and all keywords, are one lexicon, so a text is read once whatever the number of rules; a rule is a row of a table that goes to the hits by broadcast,
not a part of the plan. The lexicon's size is checked (operators.keywords).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import checks, vocabulary
from docsieve.functions.rules import SEVERITY_SCORE
from docsieve.operators import keywords, spans
from docsieve.sources.rule_packs import Field, Packs, Secret

#: Characters behind a field's name, and around a keyword, in which a value is looked for; characters before a name that its line may have.
AFTER, BEFORE = 200, 200


def _lexicon(groups: list[tuple[str, ...]]) -> tuple[list[str], list[int]]:
    """All phrases, and the group of each."""
    pairs = [(phrase, k) for k, own in enumerate(groups) for phrase in dict.fromkeys(map(vocabulary.normal, own))]
    return [p for p, _ in pairs], [k for _, k in pairs]


def _passes(check: Column, value: Column) -> Column:
    out = F.when(check == "", F.lit(True))
    for name, test in checks.CHECKS.items():
        out = out.when(check == name, test(F.upper(value)))
    return F.coalesce(out, F.lit(False))


def find(docs: DataFrame, fields: list[Field], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule, category, severity, score, start_char, end_char, matched_text) of every field's value that has its shape and passes its check. Of two names of one rule, the longer counts."""
    spark = docs.sparkSession
    phrases, groups = _lexicon([f.labels for f in fields])
    rows = [(k, f.rule, f.severity, SEVERITY_SCORE[f.severity], f.pattern() + f.end, f.pattern("(?:") + f.end, f.check, f.unless, f.whole) for k, f in enumerate(fields)]
    table = F.broadcast(spark.createDataFrame(rows, "rule_no int, rule string, severity string, score double, whole_pattern string, value_pattern string, check string, unless string, whole boolean"))
    names = F.broadcast(spark.createDataFrame(list(enumerate(groups)), "phrase int, rule_no int"))
    hits = keywords.hits(docs, phrases, BEFORE, AFTER, id_col, text_col, groups, with_text=True).join(names, "phrase").join(table, "rule_no")
    found = spans.once(hits, value=F.expr("regexp_extract(right, whole_pattern, 1)"), taken=F.expr("regexp_extract(right, value_pattern, 0)")).where("value <> ''")
    line = F.concat(F.substring_index("left", "\n", -1), F.col("found"), F.substring_index("right", "\n", 1))
    kept = found.where(_passes(F.col("check"), F.col("value"))).withColumn("line", line).where("unless = '' OR NOT line RLIKE unless")
    stop = F.col("end_char") + F.length("taken")
    text = F.when(F.col("whole"), F.concat("found", "taken")).otherwise(F.col("value"))
    return kept.select(id_col, "rule", F.lit("PII").alias("category"), "severity", "score", (stop - F.length(text)).cast("int").alias("start_char"), stop.cast("int").alias("end_char"), text.alias("matched_text"))


def secrets(docs: DataFrame, rules: list[Secret], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule, category, severity, score, start_char, end_char, matched_text): the first match of a rule's pattern behind one of its keywords on the same line, that varies enough and isn't allowed. Values of several keywords are found once."""
    spark = docs.sparkSession
    phrases, groups = _lexicon([r.keywords for r in rules])
    rows = [(k, r.rule, r.severity, SEVERITY_SCORE[r.severity], r.pattern, r.entropy, "|".join(r.allow) or "^$") for k, r in enumerate(rules)]
    table = F.broadcast(spark.createDataFrame(rows, "rule_no int, rule string, severity string, score double, pattern string, least double, allowed string"))
    names = F.broadcast(spark.createDataFrame(list(enumerate(groups)), "phrase int, rule_no int"))
    hits = keywords.hits(docs, phrases, 0, AFTER, id_col, text_col, groups).join(names, "phrase").join(table, "rule_no")
    found = spans.once(hits, value=F.expr("regexp_extract(substring_index(right, '\\n', 1), pattern, 0)")).where("value <> '' AND NOT value RLIKE allowed")
    kept = found.where((F.col("least") <= 0) | (checks.entropy(F.col("value")) >= F.col("least")))
    start = F.col("end_char") + F.expr("instr(right, value)") - 1
    out = kept.select(id_col, "rule", F.lit("PII").alias("category"), "severity", "score", start.cast("int").alias("start_char"), (start + F.length("value")).cast("int").alias("end_char"), F.col("value").alias("matched_text"))
    return out.dropDuplicates([id_col, "rule", "start_char"])


def review(docs: DataFrame, packs: Packs, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All findings of the packs' fields and patterns."""
    parts = [find(docs, packs.fields, id_col, text_col)] if packs.fields else []
    parts += [spans.find(docs, packs.patterns, id_col, text_col)] if packs.patterns else []
    if not parts:
        raise ValueError("packs without a rule")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
