"""The store of what placeholders stand for: originals under AES-GCM with a key of the session, by day, so that a day's folder is all that a purge has to delete.

A ciphertext is bound to its document and placeholder (they are its associated data): a row that is moved, altered or opened with another key gives null, and the rest stays readable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a session names the key, in hexadecimal: 16, 24 or 32 bytes.
SETTING = "docsieve.mapping.key"


def key_of(spark: SparkSession) -> bytes:
    text = spark.conf.get(SETTING, None)
    if not text or len(bytes.fromhex(text)) not in (16, 24, 32):
        raise ValueError(f"{SETTING} has to name a key of 16, 24 or 32 bytes")
    return bytes.fromhex(text)


def _bound(document: str, placeholder: str = "placeholder") -> Column:
    return F.concat_ws("|", F.col(document).cast("string"), placeholder).cast("binary")


def sealed(mapping: DataFrame, key: bytes, day: Column, document: str = "doc_id") -> DataFrame:
    """A mapping (document, placeholder, entity_type, original_text, occurrence_count) as rows of the store: the original is `secret`, the day `stored_on`. Nonces are drawn anew for each row."""
    secret = F.aes_encrypt(F.col("original_text"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray()), _bound(document))
    return mapping.select(document, "placeholder", "entity_type", "occurrence_count", F.base64(secret).alias("secret"), day.cast("date").alias("stored_on"))


def opened(store: DataFrame, key: bytes, document: str = "doc_id") -> DataFrame:
    """The mapping that rows of the store hold; original_text is null where a row isn't what was stored, or the key another."""
    text = F.try_aes_decrypt(F.unbase64("secret"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), _bound(document))
    return store.select(document, "placeholder", "entity_type", text.cast("string").alias("original_text"), "occurrence_count", "stored_on")


def save(store: DataFrame, path: str) -> None:
    """Adds rows to a store on disk, by day."""
    store.write.mode("append").partitionBy("stored_on").parquet(path)


def purge(spark: SparkSession, path: str, before: str) -> list[str]:
    """Deletes the days of a store before a day (yyyy-MM-dd); their names. Rows aren't read, and other days' files stay as they are."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    days = sorted(s.getPath().getName() for s in store.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("stored_on="))
    gone = [d for d in days if d.removeprefix("stored_on=") < before and not d.endswith("__HIVE_DEFAULT_PARTITION__")]
    for d in gone:
        store.delete(jvm.org.apache.hadoop.fs.Path(root, d), True)
    return [d.removeprefix("stored_on=") for d in gone]
