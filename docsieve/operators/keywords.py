"""Phrases of a lexicon in texts: one automaton for all of them, so that a text is read once whatever their number.

Case of Latin letters doesn't count; a blank of a phrase stands for any run of white space; a phrase that begins or ends with a letter, digit or underscore
begins or ends a word. Of phrases that overlap, the one that begins first counts, and of those the longest.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.functions.vocabulary import LOWER, edge, normal

_RUN, _LONG_RUN = re.compile(r"\s+"), re.compile(r"\s{2,}")
_WORD = re.compile(r"\w")
#: Most characters of a lexicon; what is larger has to be joined, not sent to every task.
MOST_CHARS = 1 << 25
#: Hits that are Python objects at a time.
_HITS = 1024


def automaton(phrases: list[str], groups: list[int] | None = None) -> ahocorasick.Automaton:
    """Phrases by their normal form; of equal ones in one group the first counts."""
    own: dict[str, dict[int, int]] = {}
    for k, phrase in enumerate(phrases):
        word = normal(phrase)
        if word:
            own.setdefault(word, {}).setdefault(groups[k] if groups else 0, k)
    out = ahocorasick.Automaton()
    for word, by_group in own.items():
        out.add_word(word, (len(word), edge(word[0]), edge(word[-1]), list(by_group.items())))
    out.make_automaton()
    return out


def search(found_by: ahocorasick.Automaton, text: str) -> list[tuple[int, int, int]]:
    """(phrase, start, end) of the phrases that count in one text, group by group."""
    places, lost = [0], [0]  # where the text with one blank for each run was shortened, and by how much in all
    for m in _LONG_RUN.finditer(text):
        lost.append(lost[-1] + m.end() - m.start() - 1)
        places.append(m.end() - lost[-1])
    flat = _RUN.sub(" ", text).translate(LOWER)
    candidates = []
    for last, (length, opens, closes, numbers) in found_by.iter(flat):
        start, end = last + 1 - length, last + 1
        if not (opens and start and _WORD.match(flat[start - 1])) and not (closes and end < len(flat) and _WORD.match(flat[end])):
            candidates += [(group, start, -end, k) for group, k in numbers]
    out, free, now = [], 0, None
    origin = lambda x: x + lost[bisect.bisect_right(places, x) - 1]
    for group, start, end, k in sorted(candidates):
        if group != now or start >= free:
            free, now = -end, group
            out.append((k, origin(start), origin(-end - 1) + 1))
    return out


def pieces(batches: Iterator[pa.RecordBatch], found_by: ahocorasick.Automaton, before: int, after: int) -> Iterator[pa.RecordBatch]:
    """The hits in batches (id, text), in pieces of at most _HITS rows."""
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())

    def piece(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        at, *columns = (list(c) for c in zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["id", "phrase", "start_char", "end_char", "left", "found", "right"])

    for batch in batches:
        rows: list[tuple] = []
        for k, value in enumerate(batch.column(1)):
            text = value.as_py() or ""
            for p, s, e in search(found_by, text) if len(found_by) and text else ():
                rows.append((k, p, s, e, text[max(0, s - before) : s], text[s:e], text[e : e + after]))
                if len(rows) == _HITS:
                    yield piece(batch.column(0), rows)
                    rows = []
        if rows:
            yield piece(batch.column(0), rows)


def hits(docs: DataFrame, phrases: list[str], before: int = 0, after: int = 0, id_col: str = "doc_id", text_col: str = "text", groups: list[int] | None = None, with_text: bool = False) -> DataFrame:
    """(id, phrase, start_char, end_char, left, right): phrase is a number in the list; left and right are the text around, of at most so many characters. With with_text, `found` between them is what was hit.

    Hits leave Python in pieces, so that its memory doesn't grow with the number of texts in a batch or of hits in a text. With groups, a number for each phrase, only phrases of one group contend for a place. Null text is empty; an empty lexicon finds nothing.
    """
    if sum(map(len, phrases)) > MOST_CHARS:
        raise ValueError("a lexicon of this size has to be joined")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pieces(batches, automaton(phrases, groups), before, after)

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, phrase int, start_char int, end_char int, left string, found string, right string")
    return (found if with_text else found.drop("found")).withColumnRenamed("id", id_col)
