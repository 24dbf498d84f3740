"""What the operators of this folder share: shared storage, and text kernels over Arrow buffers.

The kernels work on the UTF-8 bytes of a slice of texts at a time, so that a task's memory is bounded by the
slice and not by the partition. A word is a run of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

#: Bytes of text that a kernel takes at a time.
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only a session of this machine alone may go without: it gets a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("a cluster's session has to name a shared folder in spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="docsieve-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: its rows are fixed, and a lost executor costs no more than a read. Python gets batches of at most batch_rows (BATCH_ROWS). What was shuffled for it goes at once."""
    rows = batch_rows or BATCH_ROWS
    path = new_path(df.sparkSession, name)
    with _setting(df.sparkSession, _BATCH, lambda old: str(min(int(old), rows) if int(old) > 0 else rows)), _setting(df.sparkSession, _CLEANUP, lambda old: "true"):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_path = path
    if _scopes:
        _scopes[-1].append(table)
    return table


#: Rows of a batch that goes to Python: whole texts, and what is made of them, are held a batch at a time on either side.
BATCH_ROWS = 1000


#: Rows of an Arrow batch; and whether the files of a query's shuffles go when it has ended, not when the driver happens to collect its garbage.
_BATCH, _CLEANUP = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value):
    """A setting, made from the one before, for the job inside."""
    old = spark.conf.get(key)
    spark.conf.set(key, value(old))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def discard(table: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    jvm = table.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(table._written_path)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: The tables written by each tidy() function that runs.
_scopes: list[list[DataFrame]] = []


def tidy(function):
    """A function that returns a DataFrame, whose result is written; the tables that it wrote on the way are deleted then."""

    @functools.wraps(function)
    def run(*args, **kwargs):
        _scopes.append([])
        try:
            result = function(*args, **kwargs)
            own = _scopes.pop()
            out = written(result, function.__name__.strip("_"))
        except BaseException:
            del _scopes[:]
            raise
        for table in own:
            discard(table)
        return out

    return run


#: Bytes up to which a written table of numbers goes to every task.
BROADCAST_BYTES = 1 << 25


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, a written table of numbers, broadcast in a join if it has at most so many bytes at 8 a column and 16 a row; else the join shuffles."""
    return broadcast(df) if df.count() * (8 * len(df.columns) + 16) <= limit else df


#: Rows of one key that a task may have to take in a join.
HOT_ROWS = 4096


def lookup(rows: DataFrame, table: DataFrame, key: list[str], weight: str, most: int = HOT_ROWS) -> DataFrame:
    """Inner join of rows, a written table, with a written table that has a row a key, of which `weight` tells how many rows meet it.

    Keys that more than `most` rows meet are at most as many as the rows by `most`; they go to the rows (broadcast behind small()'s check), and no task gets all rows of such a key.
    """
    hot = small(written(table.where(F.col(weight) > most), "hot"))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(table.where(F.col(weight) <= most), key))


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs, each different (doc_id, text) once, with a number of its own in place of the id; and the ids (number, own_id, h1), h1 being a digest of the text.

    Numbers are in order of the ids, then of digests of the texts; texts without an id come last. Of rows equal in id and text, the least in the other columns stays.
    """
    digests = {"__h1": F.xxhash64(F.col("text").cast("string")), "__h2": F.xxhash64(F.lit(1), F.col("text").cast("string"))}
    rows = docs.withColumns(digests)  # names of their own, as docs may have an h1
    keys = written(rows.groupBy("doc_id", F.col("__h1").alias("h1"), F.col("__h2").alias("h2")).agg(F.count("*").alias("n")), "keys")
    if keys.where("doc_id IS NULL OR n > 1").isEmpty() and keys.groupBy("doc_id").count().where("count > 1").isEmpty():
        # The ids tell the rows apart as they are.
        return docs.withColumn("doc_id", F.col("doc_id").cast("long")), keys.select(F.col("doc_id").cast("long").alias("number"), F.col("doc_id").alias("own_id"), "h1")
    keys = written(keys.orderBy(F.asc_nulls_last("doc_id"), "h1", "h2").withColumn("number", F.monotonically_increasing_id()), "numbers")
    if not keys.where("n > 1").isEmpty():
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        least = F.min(F.struct(*others, "text")).alias("x")
        rows = rows.groupBy("doc_id", "__h1", "__h2").agg(least).select("doc_id", "__h1", "__h2", *(f"x.{c}" for c in (*others, "text")))
    same = [F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")), F.col("r.__h1") == F.col("k.h1"), F.col("r.__h2") == F.col("k.h2")]
    named = rows.alias("r").join(small(keys).alias("k"), same)
    table = named.select(*(F.col("k.number").alias(c) if c == "doc_id" else F.col(f"r.{c}") for c in docs.columns))
    return written(table, "numbered"), keys.select("number", F.col("doc_id").alias("own_id"), "h1")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty) one after the other, and the offsets of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, (_, offsets, data) = len(column), column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit bytes, or of one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUES = np.random.default_rng(2024).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Values of bytes for a second hash beside span_hashes's own.
OTHER_VALUES = np.random.default_rng(2025).integers(1, 2**64, 256, dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one running sum over the data."""
    power, inverse = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * power[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the data, and the number of each text's first word (one more at the end)."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, ...]:
    """Hash, start and end of each word, and the number of each text's first word."""
    if lower:
        data = _LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    return span_hashes(data, starts, ends), starts, ends, first


_PLACES = np.random.default_rng(7).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of size words within a text, in order; a shorter text with words is one shingle. Also where each text's begin."""
    count = np.diff(first)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    with np.errstate(over="ignore"):
        full = sum(padded[j : len(hashes) + j] * _PLACES[j] for j in range(size)) + np.uint64(size)
    out = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(out)])
    take = np.repeat(first[:-1] - begin[:-1], out) + np.arange(begin[-1])
    result = full[take] if len(take) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        for d in np.flatnonzero((count > 0) & (count < size)):
            result[begin[d]] = (hashes[first[d] : first[d + 1]] * _PLACES[: count[d]]).sum() + np.uint64(count[d])
    return mix(result), begin


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, data, offsets) of each slice of a column of texts."""
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
