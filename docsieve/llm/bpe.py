"""Byte-level BPE by a public rank file: encoding of distinct words in Arrow batches, and decoding with Spark's higher-order functions.

A task goes through its texts a slice at a time. It finds the words (matches of the splitting pattern) that it hasn't met yet,
and turns each text into numbers of its chunks (words with the spaces before them), which are split once each.
The merges of all new words go on side by side in arrays: every step joins, in each word that has one, the leftmost pair of least rank, whose rank is the id of
what it becomes, and words without a pair leave. The ranks of pairs are an array in which each pair of tokens has a slot of its own, so a lookup doesn't
depend on the vocabulary's size. Then the words' ids are put together into those of the texts.

All of that is one stage without a shuffle; words are distinct within a task, as far as it remembers them. A task remembers at most CHUNKS chunks of
CHUNK_BYTES bytes together, beside those of one slice; then it forgets them, so memory is bounded whatever the corpus.

Defined cases: a null or empty text has no ids. Texts of any length are encoded whole; the work for one word grows with the square of
its length, as each merge copies its arrays. Repeated rows give repeated rows. Columns beside the named ones aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import shared
from docsieve.llm.tokens import before_spaces, texts_of

#: Chunks that a task remembers and their bytes, bytes of text that go through a step together, bytes of words whose merges go on side by side, and shifts tried at a time for a left token's row.
CHUNKS, CHUNK_BYTES, SLICE, SIDE_BY_SIDE, TRIES = 400_000, 16 << 20, 1 << 20, 1 << 17, 512
#: Bits of a token's id, and the rank of what doesn't merge.
_ID, _NONE = 17, (1 << 17) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def displaced(pairs: dict[tuple[int, int], int]) -> tuple[list[int | None], list[int | None]]:
    """Two arrays, `shift` and `slots`: the entry of a pair (a, b) is slots[shift[a] + b], its rank beside a, and no two pairs share a slot.

    The rows of the left tokens slide over each other, the longest first, until their entries fall into free slots.
    """
    rows: dict[int, list[int]] = {}
    for left, right in pairs:
        rows.setdefault(left, []).append(right)
    width = 1 + max((b for _, b in pairs), default=0)
    free = np.ones(width + 4 * len(pairs) + TRIES, bool)
    shift: list[int | None] = [None] * (1 + max(rows, default=-1))
    random = np.random.default_rng(0)
    for left, right in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        places = np.array(right)
        while True:
            low = int(random.integers(0, len(free) - width - TRIES + 1))
            fits = np.ones(TRIES, bool)
            for b in places:
                fits &= free[low + b : low + b + TRIES]
            if fits.any():
                break
            if len(places) > 1 and random.random() < 0.01:
                free = np.concatenate([free, np.ones(len(free) // 4, bool)])
        shift[left] = low + int(np.argmax(fits))
        free[shift[left] + places] = False
    slots: list[int | None] = [None] * len(free)
    for (left, right), rank in pairs.items():
        slots[shift[left] + right] = (left << _ID) + rank
    return shift, slots


class Merges:
    """The ranks at which tokens merge, as arrays, and the merges of words."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= _NONE:
            raise ValueError(f"ranks from {_NONE} on don't fit")
        shift, slots = displaced({(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks})
        most = 1 + max(ranks.values())
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # A left token without a row looks at other rows, whose entries name another left token.
        self.shift = np.array([x or 0 for x in shift] + [0] * (most - len(shift)), np.int64)
        self.slots = np.array([-1 if x is None else x for x in slots] + [-1] * most, np.int64)

    def at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which each two tokens merge."""
        entry = self.slots[self.shift[a] + b]
        return np.where(entry >> _ID == a, entry & _NONE, _NONE)

    def merged(self, letters: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, given as their bytes one after the other and where each ends (0 first); the ids in the same form. No word is empty."""
        tokens, starts, sizes, names = self.bytes[letters], ends[:-1].astype(np.int64), np.diff(ends).astype(np.int64), np.arange(len(ends) - 1)
        ranks = np.full(len(tokens), _NONE, np.int64)
        ranks[:-1] = self.at(tokens[:-1], tokens[1:])
        ranks[starts + sizes - 1] = _NONE
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(names):
            # The least of rank and place is the leftmost pair of least rank.
            least = np.minimum.reduceat((ranks << 32) | np.arange(len(ranks)), starts)
            goes, at = least >> 32 < _NONE, least & 0xFFFFFFFF
            if not goes.all():
                stays = np.repeat(goes, sizes)
                out.append((names[~goes], sizes[~goes], tokens[~stays]))
                at = (np.cumsum(stays) - 1)[at[goes]]
                tokens, ranks, sizes, names = tokens[stays], ranks[stays], sizes[goes], names[goes]
                if not len(names):
                    break
            tokens[at] = ranks[at]
            stays = np.ones(len(tokens), bool)
            stays[at + 1] = False
            tokens, ranks, at, sizes = tokens[stays], ranks[stays], at - np.arange(len(at)), sizes - 1
            starts = np.cumsum(sizes) - sizes
            inner = at < starts + sizes - 1
            ranks[at] = _NONE
            ranks[at[inner]] = self.at(tokens[at[inner]], tokens[at[inner] + 1])
            inner = at > starts
            ranks[at[inner] - 1] = self.at(tokens[at[inner] - 1], tokens[at[inner]])
        names, sizes, flat = (np.concatenate([x[k] for x in out]) for k in range(3))
        order = np.argsort(names)
        begin = (np.cumsum(sizes) - sizes)[order]
        ends = np.concatenate([[0], np.cumsum(sizes[order])])
        return flat[np.repeat(begin - ends[:-1], sizes[order]) + np.arange(ends[-1])], ends


def _with(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class _Numbers(dict):
    """Numbers of things in the order in which they are first asked for; `new` collects them."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, thing: bytes) -> int:
        self[thing] = number = len(self)
        self.new.append(thing)
        return number


def _ends(sizes: list[int]) -> np.ndarray:
    return np.cumsum([0, *sizes]).astype(np.int32)


class _Pieces:
    """Lists of numbers by number, in one growing array."""

    def __init__(self):
        self.flat, self._begin, self._size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ends: np.ndarray, flat: np.ndarray) -> None:
        self._begin = np.concatenate([self._begin, len(self.flat) + (ends[:-1] - ends[0]).astype(np.int64)])
        self._size = np.concatenate([self._size, np.diff(ends)])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def of(self, numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of rows of numbers one after the other: where each row ends, and the numbers in them."""
        size = self._size[numbers]
        before = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(self._begin[numbers] - before[:-1], size) + np.arange(before[-1])
        return before[ends], self.flat[take]


def _encoded(words: list[bytes], ranks: dict[bytes, int], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, and where each word's end: its own rank if it has one, else what is left after all merges."""
    whole = [ranks.get(w) for w in words]
    parts = [w for w, rank in zip(words, whole, strict=True) if rank is None]
    letters, ends = np.frombuffer(b"".join(parts), np.uint8), _ends(list(map(len, parts)))
    found = [merges.merged(letters[ends[a] : ends[b]], ends[a : b + 1] - ends[a]) for a, b in shared.slices(ends, SIDE_BY_SIDE)]
    left, sizes = np.array([rank is None for rank in whole], bool), np.ones(len(words), np.int64)
    sizes[left] = np.concatenate([np.zeros(0, np.int64), *(np.diff(e) for _, e in found)])
    ids = np.zeros(sizes.sum(), np.int64)
    inside = np.repeat(left, sizes)
    ids[inside] = np.concatenate([np.zeros(0, np.int64), *(flat for flat, _ in found)])
    ids[~inside] = [rank for rank in whole if rank is not None]
    return np.concatenate([[0], np.cumsum(sizes)]), ids


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, ids array<int>) of each row; or, with digests, (id, n_tokens, ids_sha256, decoded_sha256), where the ids are decoded again."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    shared_table = spark.sparkContext.broadcast((ranks, Merges(ranks)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        ranks, merges = shared_table.value
        table = {rank: token for token, rank in ranks.items()} if digests else {}
        decimals = {rank: str(rank).encode() for rank in table}
        split = regex.compile(pattern).findall
        chunks, words, held, of_words, of_chunks = _Numbers(), _Numbers(), 0, _Pieces(), _Pieces()
        for batch in batches:
            data, offsets = shared.utf8(batch.column(1))
            for a, b in shared.slices(offsets, SLICE):
                if len(chunks) > CHUNKS or held > CHUNK_BYTES:
                    chunks, words, held, of_words, of_chunks = _Numbers(), _Numbers(), 0, _Pieces(), _Pieces()
                parts = [before_spaces(t) for t in texts_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
                texts = np.array([chunks[c] for own in parts for c in own], np.int64)
                new = [split(c.decode()) for c in chunks.new]
                numbers = np.array([words[w.encode()] for own in new for w in own], np.int64)
                held += sum(map(len, chunks.new))
                of_words.add(*_encoded(words.new, ranks, merges))
                of_chunks.add(*of_words.of(numbers, _ends(list(map(len, new)))))
                chunks.new, words.new = [], []
                ends, ids = of_chunks.of(texts, _ends(list(map(len, parts))))
                names = batch.column(0).slice(a, b - a)
                if not digests:
                    yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=[id_col, "ids"])
                    continue
                shas, decoded = [], []
                for low, high in zip(ends[:-1], ends[1:], strict=True):
                    own = ids[low:high].tolist()
                    shas.append(hashlib.sha256(b",".join(map(decimals.__getitem__, own))).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(table.__getitem__, own))).hexdigest())
                yield pa.RecordBatch.from_arrays([names, pa.array(np.diff(ends), pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return rows.mapInArrow(build, f"`{id_col}` {kind}, {out}")


def decode(rows: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """rows with `decoded`, the bytes of an array of ids: the tokens' binary pieces one after the other. Unknown ids have none."""
    table = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token.hex()
    literal = F.from_json(F.lit(json.dumps(table)), "array<string>")
    return rows.withColumn("decoded", _with(literal, lambda t: F.unhex(F.array_join(F.transform(F.coalesce(ids_col, F.expr("cast(array() as array<int>)")), lambda i: F.get(t, i)), ""))))


def op4(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per document of a table (doc_id, text): n_tokens, ids_sha256 and decoded_sha256."""
    return encode(docs, load_ranks(rank_file), pattern, digests=True)
