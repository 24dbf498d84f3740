"""From raw documents to packed training sequences, in five stages. Each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import jaccard_join, language_id, packing, secret_scan, shared, substring_dedup

#: Least pooled probability of the predicted language; below it a document is in none that was learned.
LEAST_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts that are null or without letters go."""
    return language_id.identified(docs, language_id.fit(docs.select("doc_id", "text", "lang")), LEAST_LANGUAGE_SCORE)


def _renamed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs with their own ids again."""
    found = docs.alias("d").join(shared.small(ids).alias("i"), F.col("d.doc_id") == F.col("i.number"))
    return found.select(*(F.col("i.own_id").alias(c) if c == "doc_id" else F.col(f"d.`{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id; of different texts with that id, that with the least digest.

    Rows of one id are documents each if their texts differ, else one. Documents without an id stay unless a text with an id, or an earlier one without, links with theirs.
    """
    table, ids = shared.numbered(docs)
    first = jaccard_join.join(table).where("doc_id = component_id").select("doc_id")
    return _renamed(table.join(first, "doc_id", "left_semi").select(docs.columns), ids)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every passage left only in the first document that has it, in the order of ids; different texts of one id, and those without, are documents each. Equal rows are one."""
    table, ids = shared.numbered(docs)
    return _renamed(substring_dedup.without_passages(table, substring_dedup.repeated_passages(table)), ids)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets blotted out."""
    return secret_scan.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    found = packing.packed(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("sequences", sequences),
]

#: SQL can't express a trained network or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
