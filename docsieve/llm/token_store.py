"""Token ids on disk as directly addressable codes.

An id is split into chunks of 8 bits. Level k holds chunk k of the ids that have one, with a bit for each that says whether
the id goes on in level k + 1, and a directory of the set bits before each block of 512. Token i is read from byte i of level
0; while its bit is set, the rank of that bit is its place in the next level. Nothing else has to be decoded.

A file holds the documents of one range of ids, in order:

    "DAC1" | levels u32 | documents u64 | tokens u64
    | document ids i64[documents] | starts u64[documents + 1]
    | for each level: entries u64 | chunks u8[entries] | bitmap u64[words] | ranks u64[words / 8]

Defined cases: a null text is an empty document (just its end id). Documents with equal ids stand in order of their
texts. A null id comes first. An empty table gives no files. A document longer than a file's target gets a file to itself.
Columns beside id and text aren't read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm import files, shared
from docsieve.llm.tokens import SharedEncoder, before_spaces, texts_of

MAGIC, _HEAD = b"DAC1", struct.Struct("<4sIQQ")
#: Tokens after which a file is closed.
FILE_TOKENS = 2 << 20
_NULL_ID = -(2**63)


def _bitmap(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of 64 bits, in whole blocks of 8 words, and the set bits before each block."""
    padded = np.zeros(-(-max(len(flags), 1) // 512) * 512, bool)
    padded[: len(flags)] = flags
    words = np.packbits(padded, bitorder="little").view("<u8")
    ones = np.concatenate([[0], np.cumsum(padded.reshape(-1, 512).sum(1))])[:-1]
    return words, ones.astype("<u8")


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The file of some documents: all their ids one after the other, and where each document starts."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        levels.append((rest.astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    out = [_HEAD.pack(MAGIC, len(levels), len(doc_ids), len(ids)), doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes()]
    for chunks, more in levels:
        words, ranks = _bitmap(more)
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), words.tobytes(), ranks.tobytes()]
    return b"".join(out)


class TokenFile:
    """Reads one file. read(offset, length) gives bytes of it; only what a call needs is asked for."""

    def __init__(self, read):
        self._read = read
        magic, levels, self.n_docs, self.n_tokens = _HEAD.unpack(read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self._docs_at = _HEAD.size
        at, self._levels = _HEAD.size + 16 * self.n_docs + 8, []
        for _ in range(levels):
            (entries,) = struct.unpack("<Q", read(at, 8))
            words = -(-max(entries, 1) // 512) * 8
            self._levels.append((at + 8, entries, at + 8 + entries, at + 8 + entries + 8 * words))
            at += 8 + entries + 8 * words + words
        self.size = at

    @classmethod
    def of_bytes(cls, content: bytes) -> TokenFile:
        return cls(lambda offset, length: content[offset : offset + length])

    @classmethod
    def at(cls, uri: str) -> TokenFile:
        return cls(lambda offset, length: files.read_range(uri, offset, length))

    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self._read(self._docs_at, 8 * self.n_docs), "<i8")

    def starts(self) -> np.ndarray:
        return np.frombuffer(self._read(self._docs_at + 8 * self.n_docs, 8 * self.n_docs + 8), "<u8").astype(np.int64)

    def token(self, i: int) -> int:
        """Token i of the file: a byte of each level that it reaches, and a block of bits to go on."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks_at, _, bits_at, ranks_at in self._levels:
            value |= self._read(chunks_at + i, 1)[0] << shift
            block = i // 512
            bits = np.unpackbits(np.frombuffer(self._read(bits_at + 64 * block, 64), np.uint8), bitorder="little")
            if not bits[i % 512]:
                break
            i = struct.unpack("<Q", self._read(ranks_at + 8 * block, 8))[0] + int(bits[: i % 512].sum())
            shift += 8
        return value

    def tokens(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Tokens first to last (exclusive): one range of each level."""
        a, b = first, self.n_tokens if last is None else last
        out, at, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for chunks_at, _, bits_at, ranks_at in self._levels:
            if a >= b:
                break
            out[at] |= np.frombuffer(self._read(chunks_at + a, b - a), np.uint8).astype(np.uint32) << np.uint32(shift)
            block, end = a // 512, -(-b // 512)
            bits = np.unpackbits(np.frombuffer(self._read(bits_at + 64 * block, 64 * (end - block)), np.uint8), bitorder="little")
            own = bits[a - 512 * block : b - 512 * block].astype(bool)
            a = struct.unpack("<Q", self._read(ranks_at + 8 * block, 8))[0] + int(bits[: a - 512 * block].sum())
            at, shift = at[own], shift + 8
            b = a + len(at)
        return out


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes a table (doc_id, text) and writes its files in order of doc_id. Returns the manifest: (uri, base, n_tokens, n_docs), base being the tokens in files before."""
    spark = docs.sparkSession
    encoder, folder = SharedEncoder(spark, tokenizer, before_spaces), shared.new_path(spark, "tokens")
    files.make_folder(folder)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder.get()
        held: list[np.ndarray] = []
        names: list[int] = []
        count, number = 0, 0

        def close() -> pa.RecordBatch:
            nonlocal count, number
            uri = files.attempt_name(folder, ".dac")
            starts = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            files.write(uri, encode_file(np.concatenate(held), np.array(names), starts))
            row = {"uri": [uri], "first_id": [names[0]], "number": [number], "n_tokens": [int(starts[-1])], "n_docs": [len(names)]}
            held.clear()
            names.clear()
            count, number = 0, number + 1
            return pa.RecordBatch.from_pydict(row, pa.schema([("uri", pa.string()), ("first_id", pa.int64()), ("number", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())]))

        for batch in batches:
            own = batch.column(0).fill_null(_NULL_ID).to_numpy()
            for a, b, data, offsets in shared.text_slices(batch.column(1)):
                for name, ids in zip(own[a:b], encode.encode(texts_of(data, offsets)), strict=True):
                    held.append(np.append(ids, encode.dtype.type(end_id)))
                    names.append(int(name))
                    count += len(held[-1])
                    if count >= file_tokens:
                        yield close()
        if held:
            yield close()

    written = shared.written(ordered.mapInArrow(store, "uri string, first_id long, number long, n_tokens long, n_docs long"), "manifest")
    # One row a file, so the running total is small: files of one partition share no id with another's.
    order = Window.orderBy("first_id", "number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return written.withColumn("base", F.sum("n_tokens").over(order) - F.col("n_tokens")).select("uri", "base", "n_tokens", "n_docs")


def read(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile.of_bytes(files.read(uri))
                ids, starts = file.tokens().astype("<u4"), file.starts()
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                names = file.doc_ids()
                yield pa.RecordBatch.from_arrays([pa.array(names, mask=names == _NULL_ID), pa.array(base + starts[:-1]), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = manifest.select("uri", "base").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2, "uri")
    return parts.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the ids of a table (doc_id, text) and reads the files back, a row a document."""
    return read(write(docs, tokenizer))
