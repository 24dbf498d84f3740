"""The mapping store: round trip, tampering, keys, days on disk and their purge."""

import pytest
from pyspark.sql import functions as F

from docsieve.operators import mapping_store as store

KEY = bytes(range(32))
SCHEMA = "doc_id long, placeholder string, entity_type string, original_text string, occurrence_count long, day string"
ROWS = [(1, "[PERSON_1]", "PERSON", "Jane Tan", 2, "2024-01-01"), (1, "[PERSON_2]", "PERSON", "é漢😀" * 500, 1, "2024-01-02"), (2, "[EMAIL_1]", "EMAIL", "", 1, "2024-01-02"), (3, "[EMAIL_1]", "EMAIL", None, 1, "2024-01-03"), (1, "[PERSON_1]", "PERSON", "Jane Tan", 2, "2024-01-01")]


def _sealed(spark):
    return store.sealed(spark.createDataFrame(ROWS, SCHEMA), KEY, F.col("day"))


def test_round_trip_on_disk_and_purge(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store.save(_sealed(spark), path)
    store.save(_sealed(spark).where("doc_id = 2"), path)
    back = lambda: sorted(((r["doc_id"], r["placeholder"], r["entity_type"], r["original_text"], r["occurrence_count"], str(r["stored_on"])) for r in store.opened(spark.read.parquet(path), KEY).collect()), key=repr)
    assert back() == sorted([*ROWS, ROWS[2]], key=repr)
    assert store.purge(spark, path, "2024-01-02") == ["2024-01-01"]
    assert back() == sorted([ROWS[1], ROWS[2], ROWS[2], ROWS[3]], key=repr)
    assert store.purge(spark, path, "2024-01-02") == [] and store.purge(spark, path, "2030-01-01") == ["2024-01-02", "2024-01-03"]


@pytest.mark.parametrize("change", [{"doc_id": "doc_id + 1"}, {"placeholder": "'[PERSON_9]'"}, {"secret": "base64(concat(unbase64(secret), X'00'))"}, {"secret": "'AAAA'"}])
def test_what_was_altered_does_not_open(spark, change):
    sealed = _sealed(spark).where("doc_id = 1")
    altered = sealed.withColumns({c: F.expr(x) for c, x in change.items()})
    assert [r["original_text"] for r in store.opened(altered, KEY).collect()] == [None] * 3
    assert [r["original_text"] for r in store.opened(sealed, KEY[::-1]).collect()] == [None] * 3


def test_equal_originals_differ_in_the_store(spark):
    secrets = [r["secret"] for r in _sealed(spark).where("placeholder = '[PERSON_1]'").collect()]
    assert len(set(secrets)) == 2 and "Jane" not in "".join(secrets)


def test_key_of_the_session(spark):
    with pytest.raises(ValueError):
        store.key_of(spark)
    spark.conf.set(store.SETTING, KEY.hex())
    assert store.key_of(spark) == KEY
    spark.conf.set(store.SETTING, "00")
    with pytest.raises(ValueError):
        store.key_of(spark)
    spark.conf.unset(store.SETTING)
