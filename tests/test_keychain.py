"""The keyed chain against Python's hmac, tampering in every way, and keys from the session."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from docsieve.operators import keychain

KEYS = {"v1": b"short", "v2": b"k" * 64, "v3": b"longer than a block" * 5}
SCHEMA = "seq long, ts string, event_type string, review_id long, payload string, key_version string"


def _entries(spark, reviews=5, n=20):
    rows = [(k, f"2024-01-{k + 1:02d}", "decision", r, f'{{"a":"é{k}|"}}' if k % 3 else None, list(KEYS)[k * 3 // n]) for r in range(reviews) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_hmac_equals_the_library(spark):
    texts = ["", "abc", "é漢😀" * 50, "|"]
    for key in [*KEYS.values(), b""]:
        found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(keychain.hmac_sha256(key, F.col("t"))).collect()]
        assert found == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_signed_chain_is_whole(spark):
    entries = _entries(spark).fillna({"payload": ""})
    chain = keychain.signed(entries, KEYS)
    rows = {(r["review_id"], r["seq"]): r for r in chain.collect()}
    for (review, seq), r in rows.items():
        before = rows[review, seq - 1]["hmac"] if seq else "GENESIS"
        text = f"{seq}|{r['ts']}|decision|{review}|{r['payload']}|{before}"
        assert r["prev_hash"] == before and r["hmac"] == hmac.new(KEYS[r["key_version"]], text.encode(), hashlib.sha256).hexdigest()
    assert all(r["whole"] and r["n"] == 20 for r in keychain.verified(chain, KEYS).collect())
    assert keychain.verified(chain.where("false"), KEYS).collect() == []


@pytest.mark.parametrize(
    "change, faults",
    [
        (lambda c: c.withColumn("payload", F.when(F.expr("review_id = 2 AND seq = 7"), "forged").otherwise(F.col("payload"))), (0, 0, 0, 1)),
        (lambda c: c.where("NOT (review_id = 2 AND seq = 7)"), (1, 1, 0, 0)),
        (lambda c: c.where("NOT (review_id = 2 AND seq = 0)"), (1, 1, 0, 0)),
        (lambda c: c.withColumn("key_version", F.when(F.expr("review_id = 2 AND seq = 7"), "v9").otherwise(F.col("key_version"))), (0, 0, 1, 0)),
        (lambda c: c.withColumn("hmac", F.when(F.expr("review_id = 2 AND seq = 7"), "00").otherwise(F.col("hmac"))), (0, 1, 0, 1)),
        (lambda c: c.withColumn("prev_hash", F.when(F.expr("review_id = 2 AND seq = 7"), "00").otherwise(F.col("prev_hash"))), (0, 1, 0, 1)),
    ],
)
def test_tampering_shows(spark, change, faults):
    chain = spark.createDataFrame(keychain.signed(_entries(spark).fillna({"payload": ""}), KEYS).collect())
    out = {r["review_id"]: (r["n_seq_faults"], r["n_prev_faults"], r["n_key_faults"], r["n_hmac_faults"]) for r in keychain.verified(change(chain), KEYS).collect()}
    assert out.pop(2) == faults and set(out.values()) == {(0, 0, 0, 0)}


def test_keystore(spark):
    with pytest.raises(ValueError):
        keychain.keystore(spark)
    spark.conf.set(keychain.SETTING, '{"active": "v2", "keys": {"v1": "00ff", "v2": "0a"}}')
    assert keychain.keystore(spark) == ("v2", {"v1": b"\x00\xff", "v2": b"\n"})
    spark.conf.set(keychain.SETTING, '{"active": "v3", "keys": {"v1": "00ff"}}')
    with pytest.raises(ValueError):
        keychain.keystore(spark)
    spark.conf.unset(keychain.SETTING)
