"""Fill-in-the-middle texts by a streaming matcher of constant memory.

A text is cut into units, the matches of a pattern from left to right; what the pattern skips belongs to the unit after it, and what is
left behind the last match to the suffix. The matcher goes over a text twice and stores no unit: the first pass counts the matches; with the
count the two cuts are drawn; the second advances a lazy iterator of matches to the smaller rank and then to the larger, and keeps two offsets.

A draw is a function of seed and id alone (four numbers of a SHA-256), so a lost task's rows come out the same. Markers never stand
in a transformed text's own parts: texts that hold one stay plain. Therefore form and output tell the text back.

Defined cases: a null text is empty; empty texts are plain. A null id is drawn as the empty string. Repeated rows give repeated rows;
rows of one id and different texts are drawn alike, each by its own count. Texts of any length are matched whole. Columns beside id
and text aren't read, so their names can't clash; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One code point.
CODE_POINT = r"(?s:.)"


@dataclass(frozen=True)
class Policy:
    """How texts are cut. plain and spm are per cent of texts that stay plain, and, of the others, that put the suffix first."""

    unit: str = CODE_POINT
    seed: int = 1
    plain: int = 10
    spm: int = 20


def draws(seed: int, key: str) -> list[int]:
    """Four numbers below 2**32."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def count(unit: re.Pattern, text: str) -> int:
    """The first pass."""
    return sum(1 for _ in unit.finditer(text))


def cuts(unit: re.Pattern, text: str, first: int, second: int) -> tuple[int, int]:
    """The second pass: offsets behind `first` and behind `second` units, first <= second; it goes no further than it has to."""
    matches, at, found = unit.finditer(text), 0, []
    for steps in (first, second - first):
        m = next(islice(matches, steps - 1, None), None) if steps else None
        at = m.end() if m else at
        found.append(at)
    return found[0], found[1]


def transform(text: str, key: str, unit: re.Pattern, policy: Policy) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix, middle, output) of one text; prefix and middle are lengths in code points."""
    n = count(unit, text)
    a, b, style, order = draws(policy.seed, key)
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or style % 100 >= 100 - policy.plain:
        return n, "plain", None, None, text
    first, second = cuts(unit, text, *sorted((a % (n + 1), b % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if order % 100 < policy.spm:
        return n, "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(form: str, output: str) -> str:
    """The text that a form's output was made of, from these two alone."""
    if form == "plain":
        return output
    inner = SUFFIX if form == "psm" else PREFIX
    head, _, middle = output.partition(MIDDLE)
    left, _, right = head.partition(inner)
    left = left[len(PREFIX if form == "psm" else SUFFIX) :]
    return left + middle + right if form == "psm" else right + middle + left


def transformed(docs: DataFrame, policy: Policy = Policy(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n (units), form, prefix_chars and middle_chars (null if plain) and the output."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = re.compile(policy.unit)
        for batch in batches:
            keys, ids, texts = batch.columns
            rows = [transform(t.as_py() or "", k.as_py() or "", unit, policy) for k, t in zip(keys, texts, strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *made], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).cast("string").alias("__key"), F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


@F.pandas_udf(StringType())
def restored(form, output):
    """The texts of a column of forms and one of outputs."""
    return form.combine(output, restore)


def op13(docs: DataFrame) -> DataFrame:
    """Per document: units, form, lengths, and digests of the output and of the text restored from it."""
    rows = transformed(docs)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored("form", "output").cast("binary"), 256).alias("restored_sha256"),
    )
