"""Best-fit packing of token pieces into sequences of a fixed capacity, by the configuration linear program.

Only the histogram of piece lengths reaches the driver: at most `capacity` numbers, whatever the corpus. A configuration
is a multiset of lengths that fits a sequence. The covering program over all configurations is solved by multiplicative
weights: lengths have prices, a knapsack dynamic program finds the configuration worth most at those prices, and
lengths that it covers become cheaper. Rounding applies the configurations found, the fullest first, as often as the lengths that
are left allow; what no configuration covers goes by best fit into the tightest open room.

The plan maps (length, rank among the pieces of that length) to a place, so that each task places its own pieces. Ranks come
from counts by (task, length), never from sorting the pieces of a length in one task.

Defined cases: a null text is an empty document, which still has its end id and so one piece. Documents longer than the
capacity are cut, others never. Repeated rows are packed each. An empty table packs nothing. Columns beside id and text aren't read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from docsieve.llm import shared
from docsieve.llm.tokens import SharedEncoder, at_spaces, texts_of

CAPACITY = 2048
#: Rounds of multiplicative weights, and their rate.
ROUNDS, RATE = 160, 0.25


def priced_configuration(prices: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> Counter:
    """The configuration of greatest price that fits: an unbounded knapsack, each length at most `most` times when it is traced back."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = np.searchsorted(lengths, room, "right")
        best[room] = best[room - 1]
        if fit:
            worth = best[room - lengths[:fit]] + prices[:fit]
            at = int(worth.argmax())
            if worth[at] > best[room] + 1e-15:
                best[room], choice[room] = worth[at], at
    found: Counter = Counter()
    room = capacity
    while room > 0:
        at = choice[room]
        if at < 0:
            room -= 1
            continue
        if found[int(at)] < most[at]:
            found[int(at)] += 1
        room -= int(lengths[at])
    return found


def filled(found: Counter, prices: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> Counter:
    """A configuration with what room it has left filled by the longest lengths that fit."""
    room = capacity - sum(int(lengths[i]) * n for i, n in found.items())
    at = int(np.searchsorted(lengths, room, "right")) - 1
    while at >= 0 and room >= lengths[0]:
        n = min(room // int(lengths[at]), int(most[at]) - found[at])
        if n > 0:
            found[at] += n
            room -= n * int(lengths[at])
        at = min(at - 1, int(np.searchsorted(lengths, room, "right")) - 1)
    return found


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[dict[int, int], int]]:
    """A packing of the histogram (length to count): [(configuration by length, times)]. Every piece is covered exactly once."""
    lengths = np.array(sorted(x for x, n in histogram.items() if n and x < capacity), np.int64)
    plan: list[tuple[dict[int, int], int]] = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    if not len(lengths):
        return plan
    left = np.array([histogram[int(x)] for x in lengths], np.int64)
    weights, use = lengths / capacity, Counter()
    for _ in range(rounds):
        prices = weights / left  # a piece's price; the weight is that of all pieces of its length
        found = filled(priced_configuration(prices, lengths, left, capacity), prices, lengths, left, capacity)
        key = tuple(sorted((i, n) for i, n in found.items() if n))
        use[key] += 1
        covered = np.zeros(len(lengths))
        for i, n in key:
            covered[i] = n / left[i]
        weights = weights * np.exp(-rate * covered / covered.max())
        weights /= weights.sum()
    # Rounding: the share that each configuration has in the fractional solution, scaled to cover, rounded down; then as often as fits.
    total = np.zeros(len(lengths))
    for key, n in use.items():
        for i, c in key:
            total[i] += c * n
    scale = float((left / np.maximum(total, 1e-9))[total > 0].min())
    fullness = lambda key: sum(int(lengths[i]) * c for i, c in key)
    for share in (True, False):
        for key, n in sorted(use.items(), key=lambda x: (-fullness(x[0]), x[0])):
            times = min(int(left[i]) // c for i, c in key)
            times = min(times, int(n * scale)) if share else times if fullness(key) >= capacity - 1 else 0
            if times > 0:
                plan.append(({int(lengths[i]): c for i, c in key}, times))
                for i, c in key:
                    left[i] -= c * times
    return plan + best_fit({int(x): int(n) for x, n in zip(lengths, left, strict=True) if n}, capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing on a histogram: the longest left opens a sequence, the longest that fits fills it, and the like are made at once."""
    left, plan = dict(histogram), []
    keys = sorted(left)
    while keys:
        room, found = capacity, {}
        while room > 0 and keys:
            at = bisect.bisect_right(keys, room) - 1
            while at >= 0 and left[keys[at]] <= found.get(keys[at], 0):
                at -= 1
            if at < 0:
                break
            length = keys[at]
            n = min(room // length, left[length] - found.get(length, 0))
            found[length] = found.get(length, 0) + n
            room -= n * length
        times = min(left[x] // c for x, c in found.items())
        plan.append((found, times))
        for x, c in found.items():
            left[x] -= c * times
            if not left[x]:
                keys.remove(x)
    return plan


class Places:
    """The plan as ranges of ranks: for each length, the first rank of a range, its first sequence, times, offset of the first copy."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        ranges: dict[int, list[tuple[int, int, int, int]]] = {}
        used: Counter = Counter()
        self.n_sequences = 0
        for config, times in plan:
            offset = 0
            for length in sorted(config, reverse=True):
                ranges.setdefault(length, []).append((used[length], self.n_sequences, times, offset))
                used[length] += config[length] * times
                offset += length * config[length]
            self.n_sequences += times
        self._ranges = {k: np.array(v, np.int64).T for k, v in ranges.items()}

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each (length, rank)."""
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        values, begin = np.unique(lengths[order], return_index=True)
        for length, own in zip(values, np.split(order, begin[1:]), strict=True):
            first, base, times, start = self._ranges[int(length)]
            at = np.searchsorted(first, ranks[own], "right") - 1
            q = ranks[own] - first[at]
            sequence[own] = base[at] + q % times[at]
            offset[own] = start[at] + q // times[at] * length
        return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of each document of (doc_id, text), as a written table: doc_id, piece, start, length, ids_crc32, and the task's number with the piece's place among those of its length there."""
    encoder = SharedEncoder(docs.sparkSession, tokenizer, at_spaces)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder.get(), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, b, data, offsets in shared.text_slices(batch.column(1)):
                owner, number, start, length, crc, place = [], [], [], [], [], []
                for i, ids in enumerate(encode.encode(texts_of(data, offsets))):
                    full = np.append(ids, end_id).astype("<u4")
                    raw = memoryview(full.tobytes())
                    for n, at in enumerate(range(0, len(full), capacity)):
                        size = min(capacity, len(full) - at)
                        owner.append(a + i)
                        number.append(n)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                        place.append(seen[size])
                        seen[size] += 1
                columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(owner), pa.int32()), pa.array(place, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        encode.forget()

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return shared.written(rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, place long"), "pieces")


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A table of pieces with sequence_id and offset."""
    by_task = shared.written(cut.groupBy("task", "length").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    places = Places(solve(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = by_task.select("task", "length", (F.sum("count").over(before) - F.col("count")).alias("base"))
    ranked = cut.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("place")).drop("base", "place", "task")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            rest = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sequence), pa.array(offset)], names=[*rest.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in ranked.drop("rank").schema)
    return ranked.mapInArrow(assign, f"{kinds}, sequence_id long, offset long")


def op2(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Packs a table (doc_id, text): per piece doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    found = packed(pieces(docs, tokenizer))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
