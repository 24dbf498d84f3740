"""Generated text: orders rendered as deal memos, so that rules of which real documents hold nothing have something to find.

The expressions are plain SQL that several engines read alike; money is rendered from whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsieve.sources import tables

_PERSON = "CASE o_custkey % 4 WHEN 0 THEN 'Mr Alan Tan' WHEN 1 THEN 'Ms Beth Lim' WHEN 2 THEN 'Dr Carl Ong' ELSE 'the client' END"
_CODENAME = "CASE o_orderkey % 5 WHEN 0 THEN 'project plan' WHEN 1 THEN 'Project Falcon' WHEN 2 THEN 'Project Harbor Holdings' WHEN 3 THEN 'Project Orchid' ELSE 'project code Summit' END"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'was publicly announced in a press release at https://example.com/news' WHEN 'O' THEN 'remains confidential before announcement' ELSE 'is not confidential' END"
_DEAL = "CASE o_orderkey % 7 WHEN 0 THEN 'Merger closing is subject to board approval' WHEN 1 THEN 'A share purchase agreement is in advanced discussions' WHEN 2 THEN 'No material adverse change has occurred' WHEN 3 THEN 'The acquisition is under embargo until the signing date' WHEN 4 THEN 'Earnings guidance follows policy guidance' WHEN 5 THEN 'Please forward to the insider list; restricted list applies' ELSE 'Delivery continues' END"
_IDS = "CASE o_custkey % 6 WHEN 0 THEN concat('Employee ID: EMP', CAST(10000 + o_custkey AS STRING), ', aged ', CAST(18 + o_custkey % 60 AS STRING)) WHEN 1 THEN concat('Account no: ', CAST(100000 + o_custkey AS STRING), '-', CAST(1000 + o_orderkey % 9000 AS STRING)) WHEN 2 THEN concat('SSN ', CAST(100 + o_custkey % 850 AS STRING), '-', CAST(10 + o_orderkey % 90 AS STRING), '-', CAST(1000 + o_orderkey % 9000 AS STRING)) WHEN 3 THEN concat('TFN ', CAST(100000000 + o_orderkey * 7 AS STRING), ', call +1 (555) 010-', CAST(1000 + o_custkey % 9000 AS STRING)) WHEN 4 THEN concat('ABN ', CAST(10000000000 + o_orderkey * 13 AS STRING), ', date of birth ', CAST(1950 + o_custkey % 50 AS STRING), '-', CAST(10 + o_orderkey % 4 AS STRING), '-', CAST(10 + o_orderkey % 19 AS STRING)) ELSE concat('IMEI ', CAST(350000000000000 + o_orderkey * 11 AS STRING), ', Singapore ', CAST(100000 + o_custkey AS STRING)) END"
_MONEY = "CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING)"

DOC_TYPE = "CASE o_orderkey % 3 WHEN 0 THEN 'memo' WHEN 1 THEN 'chat' ELSE 'spa' END"
TEXT = f"concat('Memo to ', {_PERSON}, ' on ', CAST(CAST(o_orderdate AS DATE) AS STRING), '.\n', {_CODENAME}, ' ', {_STATUS}, '.\n', {_DEAL}, '. The total contract value is USD ', {_MONEY}, ', discount rate 5%.\n', {_IDS}, '.')"

SQL = f"SELECT o_orderkey AS doc_id, o_custkey, o_totalprice, o_orderdate, {DOC_TYPE} AS document_type, {TEXT} AS text FROM orders"


def memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, o_custkey, o_totalprice, o_orderdate, document_type, text): one memo an order."""
    orders = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    return orders.selectExpr("o_orderkey AS doc_id", "o_custkey", "o_totalprice", "o_orderdate", f"{DOC_TYPE} AS document_type", TEXT.replace("\n", "\\n") + " AS text")
