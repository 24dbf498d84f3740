"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for a text. The ledger keeps the measurements and one bit for each rule that
failed. A policy is a mask of the rules that count, under a version; changing a policy, comparing two of them,
or asking what each rule costs alone needs only bitwise operations on the ledger, never the text again.

Defined cases: a null text is one without words. Texts of any length are measured whole. Repeated rows give
repeated ledger rows. Other columns of the input aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm import shared

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters"]
#: The rules, in the order of their bits: name, and whether it fails, from the measures. Counts only, so that every engine agrees.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("too_many_words", "n_words > 1000000"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("few_letters", "2 * n_letters < word_chars"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Policies by version: the rules that count.
POLICIES = {"base": ["few_words", "repeated_words"], "v1": [name for name, _ in RULES]}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _sum_by(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def _measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of a slice of texts; arrays over the whole slice, no loop over texts or words."""
    hashes, starts, ends, first = shared.words(data, offsets, lower=False)
    n_texts = len(offsets) - 1
    inside = ~shared._SPACE[data]
    heads = (data & 0xC0) != 0x80
    # Lines: the bytes between newlines or ends of texts.
    newline = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - (data[np.maximum(line_end - 1, 0)] == 10) if len(line_end) else line_end
    with_word = np.searchsorted(starts, line_start) < np.searchsorted(starts, line_end)
    line_start, line_end = line_start[with_word], line_end[with_word]
    line_text = np.searchsorted(offsets, line_start, "right") - 1
    line_hash = shared.span_hashes(data, line_start, line_end)
    n_lines = np.bincount(line_text, minlength=n_texts)
    salt = shared.mix(np.arange(1, n_texts + 1, dtype=np.uint64))
    _, once = np.unique(shared.mix(line_hash ^ salt[line_text]), return_index=True)
    n_distinct = np.bincount(line_text[once], minlength=n_texts)
    # Words in a three-word window that its text has twice or more.
    triples, begin = shared.shingles(hashes, first, 3)
    count = np.diff(first)
    begin_of = np.where(count >= 3, begin[:-1], 0)
    owner = np.repeat(np.arange(n_texts), np.diff(begin))
    _, inverse, times = np.unique(shared.mix(triples ^ salt[owner]), return_inverse=True, return_counts=True)
    place = np.arange(len(triples)) - begin_of[owner] + first[:-1][owner]
    place = place[(times[inverse] >= 2) & (count[owner] >= 3)]
    covered = np.zeros(len(hashes) + 3, bool)
    for j in range(3):
        covered[place + j] = True
    return {
        "n_words": count,
        "word_chars": _sum_by(inside & heads, offsets),
        "n_symbols": _sum_by(_SYMBOL[data], offsets),
        "n_dup_lines": n_lines - n_distinct,
        "n_repeat_words": _sum_by(covered[: len(hashes)], first),
        "n_lines": n_lines,
        "n_letters": _sum_by(_ASCII_LETTER[data] | (heads & (data >= 0xC3)), offsets),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, the measures, and fail_bits (bit k is set if rule k of RULES failed)."""
    schema = docs.select(F.col(id_col)).schema
    names = ", ".join(f"{m} long" for m in MEASURES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in shared.text_slices(batch.column(1)):
                found = _measure(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], names=[id_col, *MEASURES])

    kind = schema[0].dataType.simpleString()
    measured = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(measure, f"`{id_col}` {kind}, {names}")
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("int"))


def mask(rules: list[str]) -> int:
    return sum(BIT[name] for name in rules)


def passes(policy: str | list[str], bits: str = "fail_bits") -> Column:
    """Whether a ledger row passes a policy (a version, or a list of rules)."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy] if isinstance(policy, str) else policy))) == 0


def ablation(rows: DataFrame, policy: str | list[str]) -> DataFrame:
    """What each rule of a policy does: rows it fails, rows only it fails, and rows kept with it and without it. One aggregation of the ledger."""
    rules = POLICIES[policy] if isinstance(policy, str) else policy
    whole = mask(rules)
    counted = F.col("fail_bits").bitwiseAND(F.lit(whole))
    one = rows.groupBy(counted.alias("bits")).agg(F.count("*").alias("n"))  # at most 2 ** len(RULES) rows
    kept = F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0))
    cells = [
        F.struct(
            F.lit(name).alias("rule"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.lit(BIT[name])) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == BIT[name], F.col("n")).otherwise(0)).alias("n_failed_alone"),
            kept.alias("n_kept"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.lit(whole & ~BIT[name])) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
        for name in rules
    ]
    return one.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def op7(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """Per document of a table (doc_id, text): the base measures, whether the base rules fail it, and whether the policy keeps it."""
    rows = ledger(docs)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), (passes("base") & passes(policy)).alias("kept"), "n_lines", "n_letters", "fail_bits",
    )
