"""Generated text: customers rendered as agreements, with parties, defined terms, repeated names and words that only look like them; what is planted is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsieve.sources import tables


def pick(salt: int, *values: str) -> str:
    """SQL for one of the values, by customer; different salts pick independently."""
    cases = " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in enumerate(values))
    return f"CASE (CAST(c_custkey AS BIGINT) * {salt * 7919} + {salt}) % 1000003 % {len(values)} {cases} END"


FIRST = pick(7, "Jane", "Omar", "Mei-Ling", "Carlos", "Ravi", "Anna", "Tomas")
LAST = pick(11, "Tan", "Salleh", "Ong", "Rivera", "Kumar", "Novak", "Lee", "Li", "Okafor", "Lindqvist", "Tanner")
OTHER_LAST = pick(5, "Tan", "Ong", "Kumar", "Group", "Reyes", "Wong", "Abdullah")
ROLE = pick(3, "Purchaser", "Vendor", "Seller", "Company", "Tan")
DOC_TYPE = pick(13, "spa", "memo", "NDA", "chat", "term_sheet")
_PIECES = [
    "'This agreement is made between '", pick(2, "Dr", "Mr.", "prof", "Mdm"), "' '", FIRST, "' '", LAST, "' (the \"'", ROLE, "'\") and Ms '", pick(17, "Beth", "Wei", "Siti binti"), "' '", OTHER_LAST, "' of Northwind Pte Ltd.\n'",
    "'\"'", pick(19, "Completion", "Closing Date", "Target Group", "Long Stop Date"), "'\" means the day on which the shares pass. The share purchase agreement (SPA) is signed by Mr '", ROLE, "'.\n'",
    FIRST, "' '", LAST, "' shall deliver the books. '", LAST, "' confirms the price, and '", OTHER_LAST, "' countersigns; '", LAST, "'ery stock, '", LAST, "'_draft and the '", f"lower({LAST})", "' folder are excluded.\n'",
    "'Notices go to Mr Lee Ltd, to Wei '", OTHER_LAST, "' and to '", FIRST, "' '", LAST, "'; Ltd papers follow. '", ROLE, "' and Completion are terms, '", pick(23, "as is Dame Judith Hall", "Sir Humphrey stays away", "and Dr Ann Ng-Smith bin Rahman advises Ng-Smith"), "'.'",
]
TEXT = f"concat({', '.join(_PIECES)})"
SQL = f"SELECT c_custkey AS doc_id, {DOC_TYPE} AS document_type, {TEXT} AS text FROM customer"


def agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, document_type, text): one agreement a customer."""
    return tables.table(spark, sf_dir, "customer", "c_custkey").selectExpr("c_custkey AS doc_id", f"{DOC_TYPE} AS document_type", TEXT.replace("\n", "\\n") + " AS text")
