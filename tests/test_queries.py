"""Every query that has SQL against DuckDB on the same tables, as the driver compares them; and the entry points."""

import duckdb
import pytest

import __spark_entry__
from docsieve.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float) or hasattr(value, "quantize"):
        return round(float(value), 6)
    return [_plain(x) for x in value] if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, sf_dir):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr([_plain(row[i]) for i in at]) for row in result.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() >= 0 and "decision" in df.columns


def test_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
