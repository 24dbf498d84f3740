"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Queries and candidates are dealt into a grid of tiles. A tile holds one block of queries and one of candidates; the
candidates become postings by term (dimension), and a query, kept as a sparse row of its nonzero terms, scatters
weight times posting into a dense array of scores, one term after another. A partition selection takes the best
of the tile, and a ranked merge over the tiles of a query takes the best of all. Every pair is scored; nothing
is pruned, so the result is exact.

Grid: each block has a bounded number of rows whatever the table's size, so a task's memory is bounded; a row is
copied once for each block of the other side.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part. Ties go to the smaller
id. Rows with equal ids are candidates each, and queries each, with an answer a row; equal queries are searched once and answered
as often as they stand there. A query never meets candidates of its own id. With fewer than k candidates all are
returned; an empty side gives an empty result. Columns beside id and vector aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows in a tile: queries and candidates.
QUERY_BLOCK, ROW_BLOCK = 2048, 16384
#: Queries whose dense scores a task holds at a time.
_ACCUMULATORS = 64


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null where the vector takes no part."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    whole = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(whole & (F.size(vector) > 0), F.transform(numbers, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _matrix(rows: pd.Series) -> np.ndarray:
    width = max(map(len, rows))
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores that are allowed; candidates are in order of id, so ties go to the first."""
    allowed = np.flatnonzero(~own)
    values = scores[allowed]
    if len(values) > k:
        least = np.partition(values, len(values) - k)[len(values) - k]
        above = np.flatnonzero(values > least)
        allowed, values = (lambda take: (allowed[take], values[take]))(np.concatenate([above, np.flatnonzero(values == least)[: k - len(above)]]))
    return allowed


def _tile(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "key2": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
    if not len(queries) or not len(rows):
        return empty
    rows = rows.sort_values("id", kind="stable")
    ids, values = rows["id"].to_numpy(np.int64), _matrix(rows["v"])
    postings = [np.flatnonzero(values[:, d]) for d in range(values.shape[1])]
    weights = [values[at, d] for d, at in enumerate(postings)]
    names, terms = queries["id"].to_numpy(np.int64), _matrix(queries["v"])
    keys = {c: queries[c].to_numpy(np.int64) for c in ("key", "key2", "n")}
    out = []
    for first in range(0, len(names), _ACCUMULATORS):
        block = terms[first : first + _ACCUMULATORS]
        scores = np.zeros((len(block), len(ids)), np.int64)
        for d in range(min(block.shape[1], len(postings))):
            for q in np.flatnonzero(block[:, d]):
                if len(postings[d]) == len(ids):
                    scores[q] += block[q, d] * weights[d]
                else:
                    scores[q, postings[d]] += block[q, d] * weights[d]
        for q in range(len(block)):
            name = names[first + q]
            best = _best(scores[q], ids == name, k)
            out.append(pd.DataFrame({"query_id": name, **{c: x[first + q] for c, x in keys.items()}, "vec_id": ids[best], "score": scores[q][best]}))
    return pd.concat(out, ignore_index=True) if out else empty


def search(queries: DataFrame, rows: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """The k rows of highest integer inner product for each query. Both tables have (id, vector). Returns (query_id, rank, vec_id, score)."""
    spark = rows.sparkSession
    ready = lambda df: df.select(F.col("id").cast("long").alias("id"), quantised(F.col("vector"), scale).alias("v")).where("v IS NOT NULL AND id IS NOT NULL")
    queries, rows = ready(queries), ready(rows)
    # Rows of one id are told apart by digests of their vectors; equal rows are one query, n times.
    queries = queries.groupBy("id", "v").agg(F.count("*").alias("n")).withColumns({"key": F.xxhash64("v"), "key2": F.xxhash64(F.lit(1), "v")})
    n_queries, n_rows = queries.count(), rows.count()
    deep, wide = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_rows // ROW_BLOCK), min(spark.sparkContext.defaultParallelism, n_rows // 1024))
    # A row goes to one line of the grid by its place in a round-robin, which evens out any ids, and to every cell of the line.
    dealt = lambda df, n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    asked = queries.withColumn("a", dealt(queries, deep)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    there = rows.withColumn("b", dealt(rows, wide)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(deep - 1))))
    found = (
        asked.groupBy("a", "b")
        .cogroup(there.groupBy("a", "b"))
        .applyInPandas(lambda q, r: _tile(q, r, k), "query_id long, key long, key2 long, n long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id", "key", "key2").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("query_id", "rank", "vec_id", "score")


def op6(embeddings: DataFrame, k: int = 5) -> DataFrame:
    """Searches a table (vec_id, embedding): queries are the rows whose vec_id is divisible by 50, against every other row."""
    rows = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search(rows.where("id % 50 = 0"), rows, k)
