"""Generated text: customers rendered as letters with addresses of many countries, in fields, behind names, on lines of their own, of offices, and broken ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsieve.sources import tables
from docsieve.sources.agreements import FIRST, LAST, pick


def _number(least: int, span: int, salt: int) -> str:
    return f"CAST({least} + (CAST(c_custkey AS BIGINT) * {salt * 6101} + {salt}) % 1000003 % {span} AS STRING)"


_POST = _number(10000, 89999, 3)
_LINES = [
    "'Ship to '", _number(1, 9999, 5), "' '", pick(2, "Maple Street, London SW1A 1AA", "Sunset Blvd, Los Angeles CA 90028", "Collins Street Melbourne VIC 3000", "Calle Mayor, Madrid ES 28013", "Orchard Close, Leeds LS1 4DY", "Elm Street, Nowhere", "Jalan Ampang, 50450 Kuala Lumpur", "Sukhumvit Road, Bangkok 10110"), "'.\n'",
    pick(3, "Registered office at ", "Head office of the client: ", "Delivered to ", "Our organisation, "), _number(1, 999, 7), "' '", pick(5, "Queen Road, Hull HU1 2AB", "Lincoln Drive, Austin TX 78701", "Ayala Avenue, Makati 1226", "King Street, Riyadh 12345", "Nehru Marg, 110001 Delhi"), "'\n'",
    pick(7, "Home address: ", "住所：", "Mailing address : ", "address; alamat: ", "Notice Address:\n", "Address of the day "), _number(1, 500, 11), "' '", pick(11, "Station Road", "Tower Lane", "plain words", "High Street"), "',\n'",
    pick(13, "Block 12, Singapore 569933", "Flat 3, 12/F, Wan Chai, Hong Kong", "Total: 12345", "no place at all here", "Floor 2; Sydney NSW 2000"), "'\n'", pick(17, "Phone: 5551234", "Attn. reception", "second floor 7", ""), "'\n\n'",
    pick(19, "Dr ", "", "Ms "), FIRST, "' '", LAST, "', '", _number(1, 400, 13), "' '", pick(23, "Baker Street, London NW1 6XE", "Harbour Lane, old town, Singapore", "Fifth Avenue, New York 10001", "green hills, far away"), "'; signed.\n'",
    pick(29, "The patient lives near", "Correspondence for Mr Ong", "The weather in", "c/o reception, 5 Hill Road, Delhi 110001"), "'\n'", _number(1, 80, 17), "' '", pick(31, "Unit 4, Palm Road", "Marina Way", "green bottles", "Nathan Road"), "'\n'", pick(37, "Tokyo 100-0001", "Dubai 500001", "Monday 5 May", "Seoul"), "'\n'",
    pick(41, "〒100-0001 東京都千代田区千代田1-1", "06236 서울 강남구 테헤란로 152", "100080 北京市海淀区中关村大街27号", "Office 12, Sheikh Zayed Road, Dubai", "Jl. Sudirman No. 52, Jakarta 12190", "120 Le Loi Street, District 1, Hanoi 100000", "Rm 1203, 12th Floor, Central Plaza, Hong Kong"), "'\n'",
    "'Zip '", _POST, "', '", pick(43, "company address of the resident", "corporate office only", "personal note"), "' '", _number(1, 90, 19), "' '", pick(47, "Oak Avenue, Boston MA 02108", "Oak Avenue, Boston", "Rizal Street, Cebu 6000"), "'.'",
]
TEXT = f"concat({', '.join(_LINES)})"
SQL = f"SELECT c_custkey AS doc_id, {TEXT} AS text FROM customer"


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): one letter a customer."""
    return tables.table(spark, sf_dir, "customer", "c_custkey").selectExpr("c_custkey AS doc_id", TEXT.replace("\n", "\\n") + " AS text")


_YOUTH_LINES = [
    "'The pupil is '", pick(3, "aged ", "ages: ", "age=", "average "), _number(3, 24, 23), "'. She is '", _number(2, 30, 29), pick(5, "-year-old", " years old", " year old", " years older"), "'.\n'",
    pick(7, "For children under ", "Not below ", "Younger than ", "Wait under "), _number(1, 22, 31), pick(11, " years of age", ".", " bridges", ") now"), "'\n'",
    pick(13, "Primary 3 class", "secondary 2", "Year 9 student", "Year 2 of the contract", "7th grade teacher", "tier 3rd grade", "12th grade of the policy", "primary 9"), "', '", pick(17, "parental consent", "VPC form", "child's location data", "high school roster", "kindergarten teacher", "tracking of minors", "minor repairs", "personal data of a child"), "'.\n'",
    "'He has aged '", _number(10, 9, 37), pick(19, " of experience", "+ in office", " well"), "'.'",
]
YOUTH_TEXT = f"concat({', '.join(_YOUTH_LINES)})"
YOUTH_PACKS = pick(23, "US", "EU,US", "CN", "SG,IN", "XX", "CN,EU,UK", "BR,US")
YOUTH_SQL = f"SELECT c_custkey AS doc_id, {YOUTH_TEXT} AS text, string_split({YOUTH_PACKS}, ',') AS packs FROM customer"


def youth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, packs): one note on young people a customer, and the jurisdictions that it falls under."""
    return tables.table(spark, sf_dir, "customer", "c_custkey").selectExpr("c_custkey AS doc_id", YOUTH_TEXT.replace("\n", "\\n").replace("''", "\\'") + " AS text", f"split({YOUTH_PACKS}, ',') AS packs")
