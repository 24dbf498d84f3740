"""Inside information: material events by line, severity by document type, materiality ladders, blackout windows, the conjunction of elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import rules, vocabulary
from docsieve.operators import spans

#: Share of size from which an amount is medium and high, by jurisdiction; longest window in days before an announcement.
LADDERS = {"US": (0.01, 0.05), "AU": (0.05, 0.10)}
BLACKOUT_DAYS = 30


def material_events(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, line_no, n_hit, severity, public): a row for each keyword hit, whose span is the whole line; negated lines and plainly public ones give none."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line_no", "line"))
    hits = F.size(F.regexp_extract_all("line", F.lit(vocabulary.tree(vocabulary.events())), F.lit(0)))
    rows = spans.once(lines, hits=hits).where((F.col("hits") > 0) & ~F.col("line").rlike(rules.EVENT_NEGATED))
    hidden = F.col("line").rlike(vocabulary.tree(next(r.phrases for r in rules.MNPI if r.name == "nonpublic_marker")))
    rows = spans.once(rows, hidden=hidden, public=F.col("line").rlike(rules.EVENT_PUBLIC))
    severity = F.when(F.col("hidden"), "high").when(F.col("public"), "low").otherwise("medium")
    return rows.select(key, "line_no", F.explode(F.sequence(F.lit(1), F.col("hits"))).alias("n_hit"), severity.alias("severity"), "public")


def overridden(found: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """found with the severity of (rule, document type) where the table has one."""
    table = found.sparkSession.createDataFrame([(r, t, s) for (r, t), s in rules.SEVERITY_OVERRIDES.items()], "rule string, document_type string, override string")
    rows = found.join(docs.select(key, "document_type"), key).join(F.broadcast(table), ["rule", "document_type"], "left")
    return rows.withColumn("severity", F.coalesce("override", "severity")).drop("override")


def materiality(amount: Column, size: Column, jurisdiction: str, severity: Column) -> Column:
    """The severity of an amount against an entity's size; a ladder only lifts."""
    medium, high = LADDERS[jurisdiction]
    share = amount / F.nullif(size, F.lit(0.0))
    return F.when(share >= high, "high").when((share >= medium) & (severity == "low"), "medium").otherwise(severity)


def in_blackout(date: Column, announcement: Column, days: int = BLACKOUT_DAYS) -> Column:
    return F.datediff(announcement, date).between(0, days)


def conjunction(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, state, severity, start_char, end_char) of documents that hold an entity and something non-public: at most one finding each, its span the hull of its elements."""
    has = lambda *names: F.bool_or(F.col("rule").isin(*names))
    entity, hidden = has("named_person", "transaction_codename"), F.bool_or((F.col("category") == "MNPI") & (F.col("rule") != "transaction_codename"))
    state = F.when(has("definitive_agreement", "material_adverse_change"), "lexicalised").when(has("total_contract_value", "financial_amount", "financial_percentage"), "quantitative").when(has("contingent_mnpi_language"), "implied").otherwise("undetermined")
    rows = found.groupBy(key).agg(entity.alias("entity"), hidden.alias("hidden"), state.alias("state"), has("insider_list_marker", "tipping_language").alias("duty"), F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"))
    severity = F.when(F.col("duty") & (F.col("state") != "undetermined"), "high").otherwise("medium")
    return rows.where("entity AND hidden").select(key, "state", severity.alias("severity"), "start_char", "end_char")
