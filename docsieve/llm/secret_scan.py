"""Secret scans, with DataFrame functions alone.

Base kinds come from patterns. The method adds spans of its own: over each candidate string, a window of fixed
width slides through the characters of one class; counts by character are kept as it moves, one in and one out
a step, and with them the sum of c * log2(c) that gives Shannon's entropy. A candidate whose window reaches the
entropy limit of its class is a secret unless an allow-list pattern fits it or a base span overlaps it.

The sums are integers (a table of c * log2(c) in units of 2**-20), so every engine agrees on each decision.

Defined cases: a null or empty text has no spans. Texts are scanned whole. Repeated rows give repeated results.
Columns beside id and text pass through scan() untouched; its own column is `spans`, which replaces one of that name.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns (kind, pattern, group that counts, its least length), in the order of kinds.
BASE = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
#: Of the kind hex, a pattern with the same matches once short ones are dropped; it skips the many runs of a letter or two.
_LONG_HEX = r"[0-9a-f]{32,}"
WINDOW = 20
_HEX, _BASE64 = "0123456789abcdefABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="
#: Digits beyond the short number that ends a name; without them a candidate is words and names joined by marks.
_BROKEN = r"[0-9]{5}|[0-9][A-Za-z]"
#: The character classes: kind, alphabet, candidate pattern, what it must hold, least entropy of a window in bits.
CLASSES = [
    ("entropy_hex", _HEX, r"[0-9A-Fa-f]{20,}", [r"[0-9]", r"[A-Fa-f]", _BROKEN], 3.0),
    ("entropy_base64", _BASE64, r"[A-Za-z0-9+/_=-]{20,}", [r"[0-9]", r"[A-Z]", r"[a-z]", _BROKEN], 3.7),
]
#: Candidates that fit one of these are no secrets: placeholders, UUIDs.
ALLOW = [
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
]
_UNIT = 1 << 20
_TERMS = [0, *(round(c * math.log2(c) * _UNIT) for c in range(1, WINDOW + 1))]


def sum_limit(bits: float) -> int:
    """The sum of c * log2(c), in units, at or below which a window's entropy is at least so many bits."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * _UNIT)


def _runs(text: Column, pattern: str, group: int, kind: str, order: int) -> Column:
    """Array of (start, end, ord, kind, value, size): every match, leftmost first and not overlapping; size is that of a group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    none = F.expr("cast(array() as array<struct<start:int,end:int,ord:int,kind:string,value:string,size:int>>)")
    found = F.aggregate(
        F.arrays_zip(whole.alias("m"), sizes.alias("n"), gaps.alias("gap")),
        F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.when(x["m"].isNull(), s["found"]).otherwise(
                F.concat(s["found"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + F.length(x["m"])).alias("end"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), x["m"].alias("value"), x["n"].alias("size"))))
            ).alias("found"),
        ),
    )["found"]
    return F.when(F.size(whole) > 0, found).otherwise(none)


def least_window_sum(value: Column, alphabet: str) -> Column:
    """The least sum of c * log2(c), in units, over the windows of a string of the alphabet; null if it is shorter than a window.

    An even step takes a character into the counts, an odd one puts the oldest of a full window out.
    """
    codes = F.transform(F.split(value, ""), lambda c: F.call_function("locate", c, F.lit(alphabet)))
    terms = F.array(*(F.lit(t) for t in _TERMS))
    size = len(alphabet)

    def moved(state: Column, step: Column, codes: Column) -> Column:
        taken = step % 2 == 0
        i = F.floor(step / 2).cast("int")
        change = F.when(taken, 1).when(i >= WINDOW - 1, -1).otherwise(0)
        code = F.get(codes, F.when(taken, i).otherwise(F.greatest(i - (WINDOW - 1), F.lit(0))))
        count = F.element_at(state["counts"], code)
        total = state["total"] + F.get(terms, count + change) - F.get(terms, count)
        return F.struct(
            F.concat(F.slice(state["counts"], F.lit(1), code - 1), F.array(count + change), F.slice(state["counts"], code + 1, F.lit(size))).alias("counts"),
            total.alias("total"),
            F.when(taken & (i >= WINDOW - 1), F.least(state["best"], total)).otherwise(state["best"]).alias("best"),
        )

    start = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0).alias("total"), F.lit(None).cast("int").alias("best"))
    held = F.array(codes)  # evaluated once, then shared by the steps
    return F.get(F.transform(held, lambda c: F.aggregate(F.sequence(F.lit(0), 2 * F.size(c) - 1), start, lambda s, j: moved(s, j, c))["best"]), F.lit(0))


def _at_least(size: int) -> Callable[[Column], Column]:
    return lambda x: x["size"] >= size


def _of_kind(order: int) -> Callable[[Column], Column]:
    return lambda x: x["ord"] == order


def _secrets_of(alphabet: str, holds: list[str], bits: float, allow: list[str]) -> Callable[[Column], Column]:
    return lambda x: _is_secret(x["value"], alphabet, holds, bits, allow)


def _is_secret(value: Column, alphabet: str, holds: list[str], bits: float, allow: list[str]) -> Column:
    fit = F.lit(True)
    for pattern in holds:
        fit = fit & value.rlike(pattern)
    for pattern in allow:
        fit = fit & ~value.rlike(pattern)
    return F.when(fit, least_window_sum(value, alphabet) <= sum_limit(bits)).otherwise(False)


def scan(docs: DataFrame, text_col: str = "text", allow: list[str] = ALLOW, name: str = "spans") -> DataFrame:
    """docs with a column `name`: array of (start, end, ord, kind, value), code points, end exclusive, by start, then order of kinds."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,end:int,ord:int,kind:string,value:string,size:int>>)")
    likely = text.rlike("|".join([BASE[0][1], BASE[1][1], _LONG_HEX, r"[A-Za-z0-9+/_=-]{20}"]))
    base = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        runs = _runs(text, _LONG_HEX if kind == "hex" else pattern, group, kind, k)
        base.append(F.filter(runs, _at_least(least)))
    more = []
    for k, (kind, alphabet, pattern, holds, bits) in enumerate(CLASSES):
        runs = _runs(text, pattern, 0, kind, len(BASE) + k)
        more.append(F.filter(runs, _secrets_of(alphabet, holds, bits, allow)))
    rows = docs.withColumn("__base", F.when(likely, F.concat(*base)).otherwise(none))
    rows = rows.withColumn("__more", F.when(likely, F.concat(*more)).otherwise(none))
    # A span of the method stands where no base span, and no earlier kind of its own, overlaps it.
    others = F.concat("__base", "__more")
    added = F.filter("__more", lambda x: ~F.exists(others, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & (y["ord"] < x["ord"])))
    ordered = F.array_sort(F.transform(F.concat("__base", added), lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value"))))
    return rows.withColumn(name, ordered).drop("__base", "__more")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """docs with every span of scan() replaced by a mark; texts without spans, null ones too, stay as they are."""
    rows = scan(docs, text_col, name="__spans")
    text = F.col(text_col)
    pieces = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(
            F.struct(
                x["end"].alias("at"),
                F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark)))).alias("out"),
            )
        ),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))),
    )
    return rows.withColumn(text_col, F.when(F.size("__spans") > 0, pieces).otherwise(text)).drop("__spans")


def op9(docs: DataFrame) -> DataFrame:
    """Per document of a table (doc_id, text): counts of the base kinds, a digest of the base spans, and all spans as text."""
    rows = scan(docs.select("doc_id", "text"))
    label = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["ord"] < len(BASE))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", label), ",").alias("spans"))
