"""Token statistics and the nearest exemplar of a text, by an inverted index."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Terms of the advisory signal, and the weights of its parts.
TERMS = ["licensed", "license", "password", "secret", "confidential", "token", "merger", "version"]
WEIGHTS = {"deterministic": 0.55, "evidence": 0.20, "terms": 0.15, "similarity": 0.08}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_distinct and the digest of the sorted distinct tokens."""
    t = tokens(F.col(text))
    return docs.withColumns({"n_tokens": F.size(t), "n_distinct": F.size(F.array_distinct(t)), "fingerprint": F.sha2(F.array_join(F.array_sort(F.array_distinct(t)), " "), 256)})


def term_hits(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the sorted distinct terms, how many tokens are terms, and their density per 1,000 tokens."""
    t = tokens(F.col(text))
    terms = F.array(*(F.lit(x) for x in TERMS))
    hits = F.size(F.filter(t, lambda x: x.isin(TERMS)))
    return docs.withColumns({"terms": F.array_join(F.array_sort(F.array_intersect(t, terms)), ","), "n_hits": hits, "density": F.round(F.coalesce(1000 * hits / F.nullif(F.size(t), F.lit(0)), F.lit(0.0)), 4)})


#: Most characters of exemplars whose tokens are sent to every task.
MOST_CHARS = 1 << 25


def _weighted(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n, norm2): counts of tokens and the squared length of each text's vector.

    Texts are dealt by key before they fall into tokens, which then stay where they are: a text is shuffled once, its tokens never.
    """
    dealt = rows.where(F.col(key).isNotNull()).select(key, F.col(text).alias("__text")).repartition(key)
    counted = dealt.select(key, F.explode(tokens(F.col("__text"))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    return counted.withColumn("norm2", F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))


def nearest(docs: DataFrame, exemplars: DataFrame, key: str, item: str, text: str = "text") -> DataFrame:
    """(key, item, similarity): the exemplar of largest cosine for each text that shares a token with one; ties go to the smaller item.

    Texts meet exemplars only on tokens of exemplars, which are the build side where all exemplars together are small; else the join shuffles.
    """
    side = _weighted(exemplars, item, text).withColumnsRenamed({"n": "m", "norm2": "m2"})
    if (exemplars.agg(F.sum(F.length(text))).first()[0] or 0) <= MOST_CHARS:
        side = F.broadcast(side)
    met = _weighted(docs, key, text).join(side, "token").groupBy(key, item, "norm2", "m2").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    like = F.round(F.col("dot") / F.sqrt(F.col("norm2").cast("double") * F.col("m2")), 6)
    best = met.groupBy(key).agg(F.max(F.struct(like.alias("similarity"), (-F.col(item)).alias("least"))).alias("best"))
    return best.select(key, (-F.col("best.least")).alias(item), "best.similarity")


def advisory(deterministic: Column, evidence: Column, terms: Column, similarity: Column) -> Column:
    """The weighted sum of signals between 0 and 1, clamped, times 100; in decimals, so that it doesn't depend on the order of the sum."""
    parts = {"deterministic": deterministic, "evidence": evidence, "terms": terms, "similarity": similarity}
    total = sum((F.lit(Decimal(str(WEIGHTS[k]))) * F.round(v, 6).cast("decimal(10,6)") for k, v in parts.items()), F.lit(Decimal(0)))
    return F.round(100 * F.least(F.lit(Decimal(1)), F.greatest(F.lit(Decimal(0)), total)), 4).cast("double")
