"""Spans: every match of the rules in every document, as one projection and one explode.

A text is split where a pattern matches and its matches are extracted; the lengths of the pieces give the offsets. All rules go into one
array and one explode, so a document is read once whatever the number of rules, and nothing leaves the JVM. A rule's expression
runs only over texts that hold one of the literals that its matches need.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import anchors
from docsieve.functions import text as T
from docsieve.functions.checks import CHECKS
from docsieve.functions.rules import BACK, NEGATED_BACK, SEVERITY_SCORE, Rule
from docsieve.operators import keywords

_ROW = "struct<start_char:int,end_char:int,matched_text:string>"


def quoted(value: str) -> str:
    """A string as a literal of Spark's SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns, each computed once however often it is used or filtered on: the optimizer copies no expression through a generator."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


#: Matches of one text whose lengths are summed up one after the other.
_BLOCK = 64


def running(sizes: str) -> str:
    """SQL for the running sums of a non-empty array of integers, whose name is given: totals of blocks, and what an entry's block holds up to it, so that many entries cost little more than few."""
    blocks = f"sequence(0, cast((size({sizes}) - 1) DIV {_BLOCK} AS int))"
    total = f"aggregate(slice({sizes}, b * {_BLOCK} + 1, {_BLOCK}), 0, (x, z) -> x + z)"
    before = f"aggregate({blocks}, array(0), (s, b) -> concat(s, array(element_at(s, -1) + {total})))"
    return f"transform({sizes}, (z, i) -> aggregate(slice({sizes}, i DIV {_BLOCK} * {_BLOCK} + 1, i % {_BLOCK} + 1), t[i DIV {_BLOCK}], (x, y) -> x + y))".join((f"transform(array({before}), t -> ", ")[0]"))


#: A character that stands for a match when a text is split; texts that hold it are split by the pattern.
_CUT = "'\\u0001'"


def matches(text: str, pattern: str, cap: bool = False, lower: str | None = None) -> Column:
    """Array of (start_char, end_char, matched_text) of a text column, given by name; with cap, of group 1, which has to end the match.

    Given the name of a column with the text in lower case, texts without the pattern's literals aren't searched. The place of a single match is that of
    the character put in its stead. Of several, the lengths of the pieces between them, and of the matches, are summed up from left to right; split() compiles
    an expression anew for each text, so it isn't given the pattern. It is SQL text, as many small column calls take long to plan.
    """
    p = quoted(pattern)
    none = f"cast(array() AS array<{_ROW}>)"
    found = anchors.literals(pattern) if lower else []
    likely = f"({' OR '.join(f'contains({lower}, {quoted(x)})' for x in found)})" if found else f"{text} RLIKE {p}"
    value = "x.p" if cap else "x.m"
    pieces = f"named_struct('m', m{f', {chr(39)}p{chr(39)}, regexp_extract_all({text}, {p}, 1)' if cap else ''}, 'rest', regexp_replace({text}, {p}, {_CUT}))"
    span = lambda end, p: f"named_struct('start_char', {end} - length({p}), 'end_char', {end}, 'matched_text', {p})"
    single = f"transform({value}, p -> {span('instr(x.rest, ' + _CUT + ') - 1 + length(x.m[0])', 'p')})"
    sizes = f"transform(array(CASE WHEN contains({text}, {_CUT}) THEN split({text}, {p}, -1) ELSE split(x.rest, {_CUT}, -1) END), g -> zip_with(slice(g, 1, size(x.m)), x.m, (g, m) -> length(g) + length(m)))"
    several = f"transform({sizes}, sizes -> zip_with({value}, CASE WHEN size(sizes) <= {_BLOCK} THEN transform(sizes, (z, i) -> aggregate(slice(sizes, 1, i + 1), 0, (x, y) -> x + y)) ELSE {running('sizes')} END, (p, e) -> {span('e', 'p')}))[0]"
    spans = f"transform(array({pieces}), x -> CASE WHEN size(x.m) = 1 AND NOT contains({text}, {_CUT}) THEN {single} ELSE {several} END)[0]"
    return F.expr(f"CASE WHEN {likely} THEN transform(array(regexp_extract_all({text}, {p}, 0)), m -> CASE WHEN size(m) = 0 THEN {none} ELSE {spans} END)[0] ELSE {none} END")


def _named(found: DataFrame, id_col: str, rules: list[Rule], row: str) -> DataFrame:
    """Findings (id, ord, ...) with what their rule says, in the order of find()'s columns; row is the struct or prefix of the span's columns."""
    of_rule = lambda values: F.get(F.expr(f"array({', '.join(values)})"), F.col("ord"))
    return found.select(
        id_col, of_rule(quoted(r.name) for r in rules).alias("rule"), of_rule(quoted(r.category) for r in rules).alias("category"),
        of_rule(quoted(r.severity) for r in rules).alias("severity"), of_rule(f"{SEVERITY_SCORE[r.severity]}D" for r in rules).alias("score"), row,
    )


def _of_phrases(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str, guarded: bool) -> DataFrame:
    """Findings of rules with phrases, by one automaton for all of them."""
    pairs = [(p, k) for k, r in enumerate(rules) for p in r.phrases]
    hits = keywords.hits(docs, [p for p, _ in pairs], BACK, 0, id_col, text_col, [k for _, k in pairs], with_text=True)
    ord_of = F.broadcast(docs.sparkSession.createDataFrame([(n, k, rules[k].negated and guarded) for n, (_, k) in enumerate(pairs)], "phrase int, ord int, negated boolean"))
    kept = hits.join(ord_of, "phrase").where(~(F.col("negated") & F.col("left").rlike(NEGATED_BACK)))
    return _named(kept.withColumn("x", F.struct("start_char", "end_char", F.col("found").alias("matched_text"))), id_col, rules, "x.*")


def find(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", guarded: bool = True) -> DataFrame:
    """(id, rule, category, severity, score, start_char, end_char, matched_text) of every finding that passes its rule's check, guard and negation."""
    by_phrase, rules = [r for r in rules if r.phrases], [r for r in rules if not r.phrases]
    if by_phrase:
        found = _of_phrases(docs, by_phrase, id_col, text_col, guarded)
        return found.unionByName(find(docs, rules, id_col, text_col, guarded)) if rules else found
    text = F.col("__text")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn("__lower", F.lower("__text"))

    def named(rule: Rule) -> Column:
        def one(x: Column) -> Column:
            return F.struct(F.lit(rules.index(rule)).alias("ord"), x.alias("x"))

        def passes(x: Column) -> Column:
            ok = CHECKS[rule.check](x["matched_text"]) if rule.check else F.lit(True)
            if rule.negated and guarded:
                ok = ok & ~T.back(text, x["start_char"], BACK).rlike(NEGATED_BACK)
            return ok & ~T.line_of(text, x["start_char"], x["end_char"]).rlike(rule.guard) if rule.guard and guarded else ok

        found = matches("`__text`", rule.pattern, rule.cap, "`__lower`")
        return F.transform(F.filter(found, passes) if rule.check or (guarded and (rule.guard or rule.negated)) else found, one)

    found = rows.select(F.col(id_col), F.explode(F.concat(*(named(r) for r in rules))).alias("f")).select(id_col, "f.ord", "f.x")
    return _named(found, id_col, rules, "x.*")


def find_python(docs: DataFrame, rules: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule, start_char, end_char, matched_text) by Python's expressions, for rules (name, pattern) that need look-around or Unicode classes. The first group that took part is the finding."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(name, re.compile(pattern)) for name, pattern in rules]
        for frame in frames:
            rows = []
            for key, value in zip(frame[id_col], frame[text_col], strict=True):
                for name, expression in compiled:
                    for m in expression.finditer(value or ""):
                        k = next((i for i in range(1, (m.lastindex or 0) + 1) if m[i]), 0)
                        rows.append((key, name, m.start(k), m.end(k), m[k]))
            yield pd.DataFrame(rows, columns=[id_col, "rule", "start_char", "end_char", "matched_text"])

    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, rule string, start_char int, end_char int, matched_text string")


def with_lines(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """found with `line`, the line of each span."""
    both = found.join(docs.select(id_col, F.col(text_col).alias("__text")), id_col)
    return both.withColumn("line", T.line_of(F.col("__text"), F.col("start_char"), F.col("end_char"))).drop("__text")
