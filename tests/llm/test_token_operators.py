"""Packing, byte-level BPE and token files against the public libraries, a text at a time."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docsieve.llm import bpe, packing, token_store
from docsieve.llm.tokens import Encoder, at_spaces, before_spaces

WORD, BYTE, RANKS = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))


def _plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def _mixed(seed):
    rng = random.Random(seed)
    parts = ["word", " ", "  ", "\n", "\t", "\x01", " \x01 ", "é", "漢", " ", "don't", "123", "<|endoftext|>", "!!", "A", " ", "\r\n", "😀", "naïve"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 60)))


def test_chunked_encoding_equals_the_library():
    for path, chunks in ((WORD, at_spaces), (BYTE, before_spaces)):
        plain = _plain(path)
        with open(path, encoding="utf-8") as f:
            encoder = Encoder(f.read(), chunks)
        texts = [_mixed(k) for k in range(400)]
        for text, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
            assert ids.tolist() == plain(text), repr(text)


def test_packing_pieces_and_places(awkward):
    rows = packing.op2(awkward, WORD).collect()
    plain = _plain(WORD)
    expected = []
    for r in awkward.collect():
        ids = [*plain(r["text"]), 0]
        expected += [(r["doc_id"], n, at, len(ids[at : at + 2048]), _crc(ids[at : at + 2048])) for n, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-total // 2048) + 1


def test_packing_empty(empty):
    assert packing.op2(empty, WORD).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_solve_covers_each_piece_once(histogram):
    plan = packing.solve(histogram, 64, rounds=30)
    covered: dict = {}
    for config, times in plan:
        assert sum(k * n for k, n in config.items()) <= 64
        for k, n in config.items():
            covered[k] = covered.get(k, 0) + n * times
    assert {k: n for k, n in covered.items() if n} == histogram


def test_solve_is_close_to_the_bound():
    rng = random.Random(3)
    histogram: dict = {}
    for _ in range(20000):
        k = min(2048, max(1, int(rng.expovariate(1 / 400))))
        histogram[k] = histogram.get(k, 0) + 1
    used = sum(times for _, times in packing.solve(histogram))
    assert used <= 1.01 * sum(k * n for k, n in histogram.items()) / 2048


def _tiktoken():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, awkward):
    ranks, plain = _tiktoken()
    extra = spark.createDataFrame([(100 + k, _mixed(k)) for k in range(120)], "doc_id long, text string")
    rows = awkward.select("doc_id", "text").unionByName(extra)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    expected = sorted((r["doc_id"], len(ids := plain.encode_ordinary(r["text"] or "")), sha(",".join(map(str, ids)).encode()), sha((r["text"] or "").encode())) for r in rows.collect())
    assert sorted(map(tuple, bpe.op4(rows, RANKS, public_tokenizers.PATTERN).collect())) == expected
    encoded = bpe.encode(rows, ranks, public_tokenizers.PATTERN)
    back = {(r["doc_id"], bytes(r["decoded"])) for r in bpe.decode(encoded, ranks).collect()}
    assert back == {(r["doc_id"], (r["text"] or "").encode()) for r in rows.collect()}


def test_bpe_of_small_slices_and_a_long_word(spark, monkeypatch):
    """Several slices a batch, memory forgotten time and again, and a word of 6,000 letters."""
    monkeypatch.setattr(bpe, "SLICE", 300)
    monkeypatch.setattr(bpe, "CHUNKS", 150)
    ranks, plain = _tiktoken()
    rows = [(k, _mixed(k)) for k in range(80)] + [(90, "".join(_mixed(k) for k in range(400)).replace(" ", "")[:6000]), (91, None), (92, "")]
    found = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), ranks, public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["ids"] for r in found.collect()} == {k: plain.encode_ordinary(t or "") for k, t in rows}


def test_bpe_merges_side_by_side():
    """Words of all lengths at once, of letters that merge often, of any bytes, and repeated ones: each as it is by itself."""
    ranks, plain = _tiktoken()
    rng = random.Random(5)
    words = [bytes(rng.choice(b"aehnorst ") if k % 3 else rng.randrange(256) for _ in range(1 + k % 40)) for k in range(3000)] + [b"ab" * 500, b"a" * 999, b"the", b"the"]
    ends = np.cumsum([0, *map(len, words)])
    ids, at = bpe.Merges(ranks).merged(np.frombuffer(b"".join(words), np.uint8), ends)
    for k, w in enumerate(words):
        own = ids[at[k] : at[k + 1]].tolist()
        assert b"".join(plain.decode_single_token_bytes(i) for i in own) == w
        assert own == plain._encode_single_piece(w), w


def test_bpe_empty(empty):
    assert bpe.op4(empty, RANKS, public_tokenizers.PATTERN).collect() == []


def test_token_store_round_trip(awkward):
    plain = _plain(BYTE)
    docs = sorted(awkward.collect(), key=lambda r: r["doc_id"])
    expected, start = [], 0
    for r in docs:
        ids = [*plain(r["text"]), 0]
        expected.append((r["doc_id"], start, len(ids), _crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, token_store.op8(awkward, BYTE).collect())) == sorted(expected)


def test_token_store_empty(empty):
    assert token_store.op8(empty, BYTE).collect() == []


def test_token_file_random_access():
    rng = np.random.default_rng(1)
    ids = np.where(rng.random(3000) < 0.5, rng.integers(0, 300, 3000), rng.integers(0, 1 << 24, 3000)).astype(np.uint32)
    file = token_store.TokenFile.of_bytes(token_store.encode_file(ids, np.array([5, 9]), np.array([0, 1000, 3000])))
    assert file.tokens().tolist() == ids.tolist()
    assert [file.token(i) for i in range(0, 3000, 7)] == ids[::7].tolist()
    assert file.tokens(513, 1700).tolist() == ids[513:1700].tolist()
    assert file.starts().tolist() == [0, 1000, 3000]
