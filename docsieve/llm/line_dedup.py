"""Lines that many documents share, found with two Bloom filters, for keys seen once and for keys seen twice.

A line's key is the line without white space at its ends and with A-Z in lower case. A first pass hashes the keys that a document has, each once. A
task keeps the bits that one of its keys sets (once) and those that two set (twice); both are cut into segments, which Spark deals out and
adds up: a bit that is in two tasks' once-filters is in the twice-filter. A key of two documents has all its bits there, so none is lost; of the other
keys, few have. In a second pass only keys that the twice-filter holds are shuffled, as texts, for the exact count and the choice of the one document that
keeps its lines. A third pass drops the others' lines.

Sizes: the filter has BITS_PER_KEY bits for each key that the texts can hold, but at most MOST_BITS, so what goes to every task is bounded; a larger corpus
makes it less selective, more keys are shuffled, and results stay the same. Repeated keys go to all tasks as numbers if they are few (shared.small's limit);
else they reach their documents by joins.

Defined cases: null and empty texts are one empty line. A row is a document, so repeated rows count as often as they stand there, and rows with the largest id that a key
has all keep it. A null id is below all others; where a key has only such, all keep it. Lines of any length are hashed whole. Columns beside id and text aren't
read; empty tables give empty results. Ids are integers.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm import shared

LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
#: Bits of the filter for a key, at most so many in all (64 MB); bits of a segment; keys that a task gathers before it hands them on.
BITS_PER_KEY, MOST_BITS, SEGMENT, _GATHERED = 8, 1 << 29, 1 << 16, 1 << 20
_WHITE = b" \t\n\x0b\x0c\r"


@dataclass
class Lines:
    """Lines of a slice of texts: bounds, bounds of their keys, each text's first line (one more at the end); and, of keys that are long enough, line and two hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    key_starts: np.ndarray
    key_ends: np.ndarray
    first: np.ndarray
    long: np.ndarray
    h1: np.ndarray
    h2: np.ndarray

    def texts_of(self, lines: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, lines, "right") - 1


def lines(data: np.ndarray, offsets: np.ndarray, least: int = LEAST_CHARS) -> Lines:
    newline = np.flatnonzero(data == 10)
    starts, ends = np.sort(np.concatenate([offsets[:-1], newline + 1])), np.sort(np.concatenate([newline, offsets[1:]]))
    first = np.searchsorted(newline, offsets) + np.arange(len(offsets))
    low, high = starts.copy(), ends.copy()
    full = np.flatnonzero(starts < ends)
    for k in full[shared._SPACE[data[starts[full]]] | shared._SPACE[data[ends[full] - 1]]]:
        line = data[starts[k] : ends[k]].tobytes()
        low[k] += len(line) - len(line.lstrip(_WHITE))
        high[k] = low[k] + len(line.strip(_WHITE))
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = np.flatnonzero(heads[high] - heads[low] >= least)
    lower = shared._LOWER[data]
    h1, h2 = (shared.span_hashes(lower, low[long], high[long], values) for values in (shared._BYTE_VALUES, shared.OTHER_VALUES))
    return Lines(lower, starts, ends, low, high, first, long, h1, h2)


def _once(found: Lines) -> np.ndarray:
    """Places in found.long of the first line of each (text, key)."""
    texts = found.texts_of(found.long)
    order = np.lexsort((found.long, found.h2, found.h1, texts))
    same = np.zeros(len(order), bool)
    a, b = order[:-1], order[1:]
    same[1:] = (texts[a] == texts[b]) & (found.h1[a] == found.h1[b]) & (found.h2[a] == found.h2[b])
    return order[~same]


def places(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash, both in the segment that its upper part names."""
    base = ((hashes >> np.uint64(32)) % np.uint64(segments)) * np.uint64(SEGMENT)
    return base + (hashes & np.uint64(SEGMENT - 1)), base + ((hashes >> np.uint64(16)) & np.uint64(SEGMENT - 1))


def _partial(hashes: list[np.ndarray], segments: int) -> pa.RecordBatch:
    """The segments of a task's filters: bits that are set, and bits that are set twice, as numbers within the segment."""
    bits, times = np.unique(np.concatenate(places(np.concatenate(hashes), segments)), return_counts=True)
    owner, begin = np.unique(bits // SEGMENT, return_index=True)
    ends = np.append(begin[1:], len(bits))
    inner = (bits % SEGMENT).astype("<u2")
    rows = [(inner[a:b].tobytes(), inner[a:b][times[a:b] > 1].tobytes()) for a, b in zip(begin, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int32)), pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())], names=["segment", "once", "twice"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The twice-filter of each segment, from partial filters in order of segments; one segment is held at a time."""
    name, once, twice = None, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    for batch in batches:
        for segment, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if segment != name:
                if name is not None:
                    yield out()
                name = segment
                once[:] = twice[:] = False
            bits = np.frombuffer(a, "<u2")
            twice[bits[once[bits]]] = True
            twice[np.frombuffer(b, "<u2")] = True
            once[bits] = True
    if name is not None:
        yield out()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).cast("string").alias("text"))


def twice_filter(rows: DataFrame, least: int = LEAST_CHARS, most_bits: int = MOST_BITS) -> np.ndarray:
    """The bits, eight a byte, that keys of at least two documents set, and few others."""
    lines_of = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    keys = rows.agg(F.sum(F.least(lines_of, F.floor((F.length("text") + 1) / (least + 1))))).first()[0] or 0
    wanted = max(1, BITS_PER_KEY * keys // SEGMENT)
    segments = min(1 << (wanted - 1).bit_length(), max(1, most_bits // SEGMENT))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, data, offsets in shared.text_slices(batch.column(0)):
                found = lines(data, offsets, least)
                held.append(found.h1[_once(found)])
                n += len(held[-1])
                if n >= _GATHERED:
                    yield _partial(held, segments)
                    held, n = [], 0
        if n:
            yield _partial(held, segments)

    parts = rows.select("text").mapInArrow(gather, "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_added, "segment int, bits binary")
    bits = np.zeros((segments, SEGMENT // 8), np.uint8)
    for batch in merged.toArrow().to_batches():
        for segment, filled in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            bits[segment] = np.frombuffer(filled, np.uint8)
    return bits.reshape(-1)


def _held(filled: np.ndarray, hashes: np.ndarray, segments: int) -> np.ndarray:
    """Whether both bits of each hash are set."""
    one, two = (filled[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) for p in places(hashes, segments))
    return (one & two & 1).astype(bool)


def suspects(rows: DataFrame, least: int = LEAST_CHARS, most_bits: int = MOST_BITS) -> DataFrame:
    """(own, d1, d2, h1, h2, key) of each document's keys that the twice-filter holds; d1 and d2 are digests of the text."""
    bits = rows.sparkSession.sparkContext.broadcast(twice_filter(rows, least, most_bits))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = bits.value
        segments = len(filled) * 8 // SEGMENT
        for batch in batches:
            for start, end, data, offsets in shared.text_slices(batch.column(3)):
                found = lines(data, offsets, least)
                k = _once(found)
                k = k[_held(filled, found.h1[k], segments)]
                texts = found.texts_of(found.long[k])
                keys = [found.data[a:b].tobytes() for a, b in zip(found.key_starts[found.long[k]], found.key_ends[found.long[k]], strict=True)]
                own = [c.slice(start, end - start).take(pa.array(texts)) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found.h1[k].view(np.int64)), pa.array(found.h2[k].view(np.int64)), pa.array(keys, pa.binary()).cast(pa.string())], names=["own", "d1", "d2", "h1", "h2", "key"])

    named = rows.select("own", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"), "text")
    return named.mapInArrow(test, "own long, d1 long, d2 long, h1 long, h2 long, key string")


@shared.tidy
def repeated_lines(rows: DataFrame, least: int = LEAST_CHARS, documents: int = LEAST_DOCUMENTS, most_bits: int = MOST_BITS) -> DataFrame:
    """(h1, h2, n, last) of each key that enough documents have; n of them, and the largest id among them. The texts of keys are compared; tasks add up their own before the shuffle."""
    counted = suspects(rows, least, most_bits).groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("last"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    return counted.where(F.col("n") >= documents).select("h1", "h2", "n", "last")


@dataclass
class Repeated:
    """Repeated keys in order of their hashes, and the id that keeps each; lone where it is null."""

    h1: np.ndarray
    h2: np.ndarray
    last: np.ndarray
    lone: np.ndarray

    @staticmethod
    def of(h1: pa.Array, h2: pa.Array, last: pa.Array) -> Repeated:
        a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (h1, h2))
        order = np.argsort(a, kind="stable")
        return Repeated(a[order], b[order], last.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[order], last.is_null().to_numpy(zero_copy_only=False)[order])

    @functools.cached_property
    def _same(self) -> int:
        """The most rows that have one first hash."""
        return int(np.unique(self.h1, return_counts=True)[1].max()) if len(self.h1) else 0

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at, out = np.searchsorted(self.h1, h1), np.full(len(h1), -1)
        for k in range(self._same):
            there = np.minimum(at + k, len(self.h1) - 1)
            out = np.where((self.h1[there] == h1) & (self.h2[there] == h2), there, out)
        return out


def _dropped(found: Lines, repeated: Repeated, own: pa.Array) -> np.ndarray:
    """The lines to drop."""
    row = repeated.find(found.h1, found.h2)
    line, row = found.long[row >= 0], row[row >= 0]
    text = found.texts_of(line)
    number, null = own.fill_null(0).to_numpy(zero_copy_only=False)[text], own.is_null().to_numpy(zero_copy_only=False)[text]
    keeps = np.where(repeated.lone[row], null, ~null & (number == repeated.last[row]))
    return line[~keeps]


def _kept(data: np.ndarray, offsets: np.ndarray, found: Lines, dropped: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Lines dropped from each text, and the texts without them."""
    n = np.bincount(found.texts_of(dropped), minlength=len(offsets) - 1)
    gone, raw, texts = np.zeros(len(found.starts), bool), data.tobytes(), []
    gone[dropped] = True
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if n[k]:
            own = np.arange(found.first[k], found.first[k + 1])
            own = own[~gone[own]]
            texts.append(b"\n".join(raw[s:e] for s, e in zip(found.starts[own].tolist(), found.ends[own].tolist(), strict=True)))
        else:
            texts.append(raw[a:b])
    return n, texts


def _batch(own: pa.Array, column: pa.Array, repeated: Repeated, least: int) -> Iterator[pa.RecordBatch]:
    for start, end, data, offsets in shared.text_slices(column):
        found, ids = lines(data, offsets, least), own.slice(start, end - start)
        n, texts = _kept(data, offsets, found, _dropped(found, repeated, ids))
        made = [ids, pa.array(np.diff(found.first)), pa.array(n.astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(made, names=["own", "n_lines", "n_dropped", "text"])


def deduplicated(docs: DataFrame, least: int = LEAST_CHARS, documents: int = LEAST_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS, limit: int = shared.BROADCAST_BYTES) -> DataFrame:
    """Per document: id, n_lines before, n_dropped and the text of the lines that stay. Keys shorter than `least` code points, or in fewer `documents`, stay."""
    rows = _rows(docs, id_col, text_col)
    table = repeated_lines(rows, least, documents, most_bits)
    schema = "own long, n_lines long, n_dropped long, text string"
    if table.count() * 40 <= limit:
        repeated = rows.sparkSession.sparkContext.broadcast(table.select("h1", "h2", "last").toArrow().combine_chunks())

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Repeated.of(*(c.combine_chunks() for c in repeated.value.columns))
            for batch in batches:
                yield from _batch(batch.column(0), batch.column(1), own, least)

        return rows.mapInArrow(drop, schema).withColumnRenamed("own", id_col)

    def drop_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten()
            yield from _batch(batch.column(0), batch.column(1), Repeated.of(*(x.field(k) for k in range(3))), least)

    keys = shared.written(suspects(rows, least, most_bits).select("own", "d1", "d2", "h1", "h2").distinct(), "suspects")
    lists = shared.lookup(keys, table, ["h1", "h2"], "n").groupBy("own", "d1", "d2").agg(F.collect_list(F.struct("h1", "h2", "last")).alias("repeats"))
    named = rows.withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(1), "text")}).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in ("own", "d1", "d2")]
    with_lists = named.join(lists.alias("l"), same, "left").select("r.own", "r.text", F.coalesce("l.repeats", F.expr("cast(array() AS array<struct<h1: bigint, h2: bigint, last: bigint>>)")))
    return with_lists.mapInArrow(drop_own, schema).withColumnRenamed("own", id_col)


def op12(docs: DataFrame) -> DataFrame:
    """Per document: lines before, lines dropped, and a digest of the text that stays."""
    return deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
