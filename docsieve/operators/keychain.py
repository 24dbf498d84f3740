"""A keyed chain over a journal: each entry's HMAC covers the entry and the HMAC of the entry before, under a key that its version names.

Signing goes along each review, as every entry needs the one before: entries are dealt by review and streamed in order, one HMAC held at a time. Checking doesn't: every
entry is checked by itself from what it says of the one before, with SQL functions, so a long review is spread like any other rows.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GENESIS = "GENESIS"
#: Where a session names the keys: JSON with the active version, and keys by version in hexadecimal.
SETTING = "docsieve.journal.keys"


def keystore(spark: SparkSession) -> tuple[str, dict[str, bytes]]:
    """The active version and all keys, as the session names them."""
    text = spark.conf.get(SETTING, None)
    if not text:
        raise ValueError(f"no keys in {SETTING}")
    body = json.loads(text)
    keys = {version: bytes.fromhex(key) for version, key in body["keys"].items()}
    if body["active"] not in keys:
        raise ValueError(f"no key for the active version {body['active']}")
    return body["active"], keys


def message(digest: str = "prev_hash") -> Column:
    """What an entry's HMAC covers."""
    return F.concat_ws("|", "seq", "ts", "event_type", "review_id", "payload", digest)


def hmac_sha256(key: bytes, text: Column) -> Column:
    """HMAC of a text under a key, in hexadecimal."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def signed(entries: DataFrame, keys: dict[str, bytes]) -> DataFrame:
    """entries (seq, ts, event_type, review_id, payload, key_version, ...) with prev_hash and hmac, along each review in order of seq. Texts that the HMAC covers are cast to strings; a version without a key raises an error."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("seq", "ts", "event_type", "review_id", "payload")]
    rows = entries.select("*", F.concat_ws("|", *text).alias("__message"), F.col("review_id").cast("string").alias("__review"), F.col("key_version").alias("__version"))
    columns = entries.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        review, last = None, GENESIS
        for batch in batches:
            before, after = [], []
            names = batch.schema.names
            for body, own, version in zip(*(batch.column(names.index(c)).to_pylist() for c in ("__message", "__review", "__version")), strict=True):
                if own != review or review is None:
                    review, last = own, GENESIS
                before.append(last)
                last = hmac.new(keys[version], f"{body}|{last}".encode(), hashlib.sha256).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in columns), pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*columns, "prev_hash", "hmac"])

    return rows.repartition("review_id").sortWithinPartitions("review_id", "seq").mapInArrow(sign, f"{kinds}, prev_hash string, hmac string")


def faults(entries: DataFrame, keys: dict[str, bytes]) -> DataFrame:
    """entries with what is wrong with each: seq_fault (it doesn't follow the entry before), prev_fault (it names another HMAC than that), key_fault (no such key), hmac_fault (its own isn't right)."""
    order = Window.partitionBy("review_id").orderBy("seq", "hmac")
    versions = {version: hmac_sha256(key, message()) for version, key in keys.items()}
    expected = F.lit(None).cast("string")
    for version, value in versions.items():
        expected = F.when(F.col("key_version") == version, value).otherwise(expected)
    known = F.coalesce(F.col("key_version").isin(list(keys)), F.lit(False))
    return entries.select(
        "*", (F.col("seq") != F.coalesce(F.lag("seq").over(order) + 1, F.lit(0))).alias("seq_fault"), (F.col("prev_hash") != F.coalesce(F.lag("hmac").over(order), F.lit(GENESIS))).alias("prev_fault"),
        (~known).alias("key_fault"), (known & (F.col("hmac") != expected)).alias("hmac_fault"),
    )


def verified(entries: DataFrame, keys: dict[str, bytes]) -> DataFrame:
    """Per review: entries, faults by kind, and whether the chain is whole."""
    kinds = ["seq_fault", "prev_fault", "key_fault", "hmac_fault"]
    counts = faults(entries, keys).groupBy("review_id").agg(F.count("*").alias("n"), *(F.count_if(k).alias(f"n_{k}s") for k in kinds))
    return counts.withColumn("whole", F.expr(" + ".join(f"n_{k}s" for k in kinds)) == 0)
