"""Singling out: quasi-identifiers that together point at few people."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifying weight by rule, and rules that identify by themselves.
WEIGHTS = {"age_reference": 0.6, "date_of_birth": 1.0, "sg_postal_address": 0.8, "named_person": 0.9, "employee_id": 1.0, "phone_number": 0.7, "imei": 0.9}
DIRECT = ["us_ssn", "sg_nric_fin", "passport_number", "bank_account", "au_tfn"]
#: Documents whose spans are Python objects at a time.
_ROWS = 256


def weights(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, weight, n_rules, direct): each distinct rule counts once, with its largest weight."""
    table = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    held = found.groupBy(key).agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    rows = held.withColumn("w", F.transform("rules", lambda r: F.coalesce(F.element_at(table, r), F.lit(0.0))))
    total = F.round(F.aggregate("w", F.lit(0.0), lambda s, x: s + x), 6)
    return rows.select(key, total.alias("weight"), F.size(F.filter("w", lambda x: x > 0)).cast("long").alias("n_rules"), F.exists("rules", lambda r: r.isin(DIRECT)).alias("direct"))


def k_anonymity(weighted: DataFrame, population: str) -> DataFrame:
    """weighted with k, severity and probability. A direct identifier makes k 1; a heavy combination bounds a large k."""
    weight = F.col("weight")
    bound = F.when(weight >= 2.2, 1).when(weight >= 1.8, 3).otherwise(10)
    k = F.when(F.col("direct"), 1).when(F.col(population) < 20, F.col(population)).when(weight >= 1.4, F.least(F.col(population), bound)).otherwise(F.col(population))
    rows = weighted.withColumn("k", k.cast("long"))
    severity = F.when(F.col("k") < 2, "high").when(F.col("k") < 5, "medium").otherwise("low")
    return rows.withColumn("severity", severity).withColumn("probability", F.round(1 / F.greatest(F.col("k"), F.lit(1)), 6))


def seeds(found: DataFrame, reach: int = 500, least: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, start_char, end_char, n_rules): clusters taken from left to right, of spans that start within reach of the first one and hold enough distinct rules. A cluster's spans aren't used again, so the state restarts: a document's spans are one row, in order, and Python takes _ROWS of them at a time."""
    kind = found.schema[key].dataType.simpleString()

    def walk(ordered: list[tuple]) -> list[tuple]:
        out, i = [], 0
        while i < len(ordered):
            j = i
            while j < len(ordered) and ordered[j][0] <= ordered[i][0] + reach:
                j += 1
            near = ordered[i:j]
            names = len({rule for _, _, rule in near})
            if names >= least:
                out.append((near[0][0], max(e for _, e, _ in near), names))
                i = j
            else:
                i += 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                lists = part.column(1)
                values = [lists.flatten().field(k).to_pylist() for k in range(3)]
                spans, out, at = list(zip(*values, strict=True)), [], 0
                for k, size in enumerate(lists.value_lengths().to_pylist()):
                    out += [(k, *x) for x in walk(spans[at : at + size])]
                    at += size
                if out:
                    rows, *columns = (list(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *(pa.array(c, pa.int32()) for c in columns)], names=["id", "start_char", "end_char", "n_rules"])

    # Documents with fewer rules have no cluster and stay in the JVM.
    spans = F.array_sort(F.collect_list(F.struct("start_char", "end_char", "rule")))
    rows = found.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(spans.alias("spans"))
    rows = rows.where(F.size(F.array_distinct("spans.rule")) >= least)
    return rows.mapInArrow(run, f"id {kind}, start_char int, end_char int, n_rules int").withColumnRenamed("id", key)


def greedy_matches(predicted: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_predicted, n_gold, n_matched): predictions in order each take the first overlapping gold span that is left."""
    kind = predicted.schema[key].dataType.simpleString()

    def match(k: tuple, p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        left = sorted(zip(g.start_char, g.end_char, strict=True))
        n = 0
        for s, e in sorted(zip(p.start_char, p.end_char, strict=True)):
            for i, (a, b) in enumerate(left):
                if s < b and a < e:
                    left.pop(i)
                    n += 1
                    break
        return pd.DataFrame({key: [k[0]], "n_predicted": [len(p)], "n_gold": [len(g)], "n_matched": [n]})

    pair = predicted.select(key, "start_char", "end_char").groupBy(key).cogroup(gold.select(key, "start_char", "end_char").groupBy(key))
    return pair.applyInPandas(match, f"`{key}` {kind}, n_predicted long, n_gold long, n_matched long")


