"""Token ids by a public tokenizer's file, with a bounded cache of the encodings of chunks.

A text is cut where no match of the tokenizer's own splitting pattern can lie across, so that the ids of the chunks, one
after the other, are the ids of the text. Most chunks repeat, and the library encodes each of them once a task.
"""

from __future__ import annotations

import os
import re

import numpy as np
from pyspark.sql import SparkSession

#: Chunks in each of the two generations that a worker remembers, and the longest it remembers, in bytes.
CACHED, CACHED_BYTES = 700_000, 200
_BEFORE_SPACE = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space beyond ASCII, in UTF-8; beside ASCII spaces it forms one run, which mustn't be cut.
_WIDE_SPACE = re.compile(rb"\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def at_spaces(text: bytes) -> list[bytes]:
    """Chunks for a tokenizer that drops white space: what stands between ASCII spaces."""
    return text.split()


def before_spaces(text: bytes) -> list[bytes]:
    """Chunks for a tokenizer that keeps spaces: a run of ASCII spaces goes with what follows it."""
    return [text] if _WIDE_SPACE.search(text) else _BEFORE_SPACE.findall(text)


#: Stands between chunks that are encoded in one call. Chunks that hold it, or that could touch it, are encoded alone.
_MARK = b" \x01"


class Encoder:
    """Encodes texts by a tokenizer file's content. It is built once a worker. Its cache has two generations, so that what is used stays."""

    def __init__(self, content: str, chunks=before_spaces):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self._tokenizer = Tokenizer.from_str(content)
        self._tokenizer.encode_special_tokens = True
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self.dtype = np.dtype("<u2") if self._tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._chunks, self._known, self._old = chunks, {}, {}
        self._drops_space = chunks is at_spaces
        self._mark = self._alone(_MARK)

    def _alone(self, chunk: bytes) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([chunk.decode()], add_special_tokens=False)[0].ids, self.dtype)

    def _together(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk, as bytes: one call for all, cut at the ids of the mark."""
        joined = b"".join([c + _MARK + b" " if self._drops_space else c + _MARK for c in chunks])
        ids = self._alone(joined)
        ends = np.flatnonzero(ids == self._mark[-1])
        if len(ends) != len(chunks):
            return [self._alone(c).tobytes() for c in chunks]
        raw, width, rest = ids.tobytes(), self.dtype.itemsize, len(self._mark) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        return [raw[width * a : width * (b - rest)] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]

    def _learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new chunks."""
        easy = [x for x in chunks if len(x) <= CACHED_BYTES and b"\x01" not in x and (self._drops_space or x[0] in b" \n\t\r")]
        found = {x: self._alone(x).tobytes() for x in set(chunks).difference(easy)} if len(easy) < len(chunks) else {}
        for at in range(0, len(easy), 4096):
            some = easy[at : at + 4096]
            found.update(zip(some, self._together(some), strict=True))
        return found

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        parts = [self._chunks(t) for t in texts]
        if len(self._known) > CACHED:
            self._old, self._known = self._known, {}
        known, old = self._known, self._old
        new = []
        for c in set().union(*parts):
            if c not in known:
                if c in old:
                    known[c] = old[c]
                else:
                    new.append(c)
        known.update(self._learn(new))
        out = [np.frombuffer(b"".join(map(known.__getitem__, own)), self.dtype) for own in parts]
        for c in new:
            if len(c) > CACHED_BYTES:
                del known[c]
        return out


    def forget(self) -> None:
        """Empties the cache, so that a worker that waits for other work holds little."""
        self._known, self._old = {}, {}


_encoders: dict[tuple, Encoder] = {}


class SharedEncoder:
    """A tokenizer file sent to the executors once (a file of a few MB); get() builds the worker's encoder."""

    def __init__(self, spark: SparkSession, path: str, chunks):
        with open(path, encoding="utf-8") as f:
            self._content = spark.sparkContext.broadcast(f.read())
        self._key, self._chunks = (path, chunks.__name__), chunks

    def get(self) -> Encoder:
        if self._key not in _encoders:
            _encoders[self._key] = Encoder(self._content.value, self._chunks)
        return _encoders[self._key]


def texts_of(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
