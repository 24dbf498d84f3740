"""Conversation trie, line dedup and fill-in-the-middle against brute force, on small tables with the awkward cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docsieve.llm import conversation_trie, fill_in_middle, line_dedup, shared
from tests.llm.conftest import prose

TURNS = "conv_id long, turn long, role string, text string, depth long, size long, block long"


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _trie(rows, heads, base):
    """Rows (conv_id, turn, role, text): the nodes by plain dictionaries."""
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(own, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, own in turns.items()}
    rebuilt = {c: turns.get(base(c), [])[: heads(c)] + own[heads(c) :] for c, own in turns.items()}
    members = {}
    for c, own in rebuilt.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    out = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        leaf = lambda k: not any(len(o) == len(k) + 1 and o[:-1] == k for o in members)
        out.append((
            min(own), len(key), min(members[key[:-1]]) if key else None, len(own), sum(len(o) == len(key) + 1 and o[: len(key)] == key for o in members),
            sum(map(leaf, below)), sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k), _sha(",".join(str(c) for c in sorted(own) if len(rebuilt[c]) == len(key))),
        ))
    return sorted(out)


def _conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 40), 100, 101, 102, 199, 205, -5, -120, 7_000_000_001]:
        for t in range(rng.randrange(0, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ho", "", None, "é漢😀"])))
    rows += [(3, None, "system", "first"), (4, 1, "user", "tie"), (4, 1, "user", "tie"), (4, 1, "assistant", "tie"), (None, 0, "user", "lost"), (50, None, None, None)]
    rows += [(60 + k, t, "user", f"same {t}") for k in range(6) for t in range(7)] + [(70, t, "user", f"same {t}") for t in range(12)]
    return rows


def _collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_trie(spark):
    rows = _conversations()
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS).repartition(5)
    assert _collected(conversation_trie.trie(table)) == _trie(rows, lambda c: 0, lambda c: c)
    truncated = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    assert _collected(conversation_trie.op11(table)) == _trie(rows, lambda c: zlib.crc32(str(c).encode()) % 6, truncated)


def test_trie_blocks(spark, monkeypatch):
    """Conversations, end lists and chains over many blocks, and parents with more children than one task takes."""
    monkeypatch.setattr(conversation_trie, "BLOCK", 2)
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    monkeypatch.setattr(shared.lookup, "__defaults__", (3,))
    rng = random.Random(5)
    rows = [(c, t, "user", f"{rng.randrange(2) if t > 20 else 0}") for c in range(30) for t in range(rng.choice([25, 30, 31]))]
    rows += [(200 + c, t, "user", f"own {c}" if t else "start") for c in range(20) for t in range(3)] + [(300, t, "user", "x" * 1000) for t in range(50)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert _collected(conversation_trie.trie(table)) == _trie(rows, lambda c: 0, lambda c: c)
    assert _collected(conversation_trie.op11(table)) == _trie(rows, lambda c: zlib.crc32(str(c).encode()) % 6, lambda c: c - c % 100)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversation_trie.op11(empty).collect() == []
    assert conversation_trie.op11(spark.createDataFrame([(None, 1, "user", "x", 0, 0, 0)], TURNS)).collect() == []
    # Conversation 101 takes up to five turns of conversation 100, which isn't there, and loses as many of its own.
    lost = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    assert _collected(conversation_trie.op11(spark.createDataFrame([(lost, 1, "user", "x", 0, 0, 0)], TURNS))) == [(lost, 0, None, 1, 0, 1, 0, _sha(str(lost)))]


def _key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def _deduplicated(rows, least=40, documents=5):
    holders = {}
    for n, (i, text) in enumerate(rows):
        for key in {_key(x) for x in (text or "").split("\n")}:
            if len(key) >= least:
                holders.setdefault(key, []).append((n, i))
    last = {k: max((i for _, i in own if i is not None), default=None) for k, own in holders.items() if len(own) >= documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if _key(x) not in last or last[_key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def _lines():
    common, other = "This Line  stands in many documents of the table, again", "une autre ligne é à ü 漢字 qui se répète dans la table"
    rows = [(k, f"{prose(k, 12)}\n  {common if k % 2 else common.upper()}\t\n{other if k < 5 else ''}\n{prose(100 + k, 9)}") for k in range(12)]
    rows += [(None, common), (None, None), (20, ""), (21, "\n\n"), (22, f"{common}\n{common}\r\n\x0b{common}"), (22, f"{common}\nx"), (23, f"{other}\n" * 3), (9, "a" * 50 + "\n" + "short line\n" * 8)]
    rows += [(30 + k, "Only four documents hold this line of the text, no more") for k in range(4)] + [(40 + k, "é" * 39 + "\n" + "é" * 40) for k in range(6)]
    rows += [(None, "A line that only rows without an id hold, five times in all") for _ in range(5)] + [(50, "z" * 300_000 + "\n" + common)]
    return rows


DOCS = "doc_id long, text string, key string, h1 long, n long, last long, own long, repeats long"


@pytest.mark.parametrize("limit, bits", [(1 << 25, 1 << 29), (0, 1 << 29), (1 << 25, 1 << 16)])
def test_line_dedup(spark, limit, bits):
    """Both ways to hand repeated keys out, and a filter that is far too small."""
    rows = _lines()
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5) for i, t in rows], DOCS).repartition(4)
    out = line_dedup.deduplicated(docs, limit=limit, most_bits=bits)
    assert sorted((tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr) == _deduplicated(rows)


def test_line_dedup_digest_and_empty(spark):
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5) for i, t in _lines()], DOCS)
    assert sorted(map(tuple, line_dedup.op12(docs).collect()), key=repr) == sorted(((i, n, d, _sha(t)) for i, n, d, t in _deduplicated(_lines())), key=repr)
    assert line_dedup.op12(docs.where("false")).collect() == []


def test_twice_filter_holds_every_repeated_key(spark):
    """No key of two documents is missing, however the documents are dealt; few others are there."""
    rng = np.random.default_rng(4)
    lines = [prose(k, 14) for k in range(4000)]
    rows = [(k, "\n".join(lines[j] for j in (k, int(rng.integers(2000, 2100))))) for k in range(2000)]
    table = line_dedup._rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), "doc_id", "text")
    bits = line_dedup.twice_filter(table)
    repeated = {x for x in lines[2000:2100] if sum(x in t.split("\n") for _, t in rows) > 1}
    found = {r["key"] for r in line_dedup.suspects(table).collect()}
    assert repeated <= found and len(found - repeated) < 200
    assert line_dedup._held(bits, np.zeros(0, np.uint64), len(bits) * 8 // line_dedup.SEGMENT).shape == (0,)


def test_colliding_hashes_are_told_apart():
    table = line_dedup.Repeated.of(pa.array([5, 5, 7]), pa.array([1, 2, 3]), pa.array([10, None, 30]))
    found = table.find(np.array([5, 5, 5, 7, 8], np.uint64), np.array([2, 1, 3, 3, 3], np.uint64))
    assert [None if k < 0 else (int(table.last[k]), bool(table.lone[k])) for k in found] == [(0, True), (10, False), None, (30, False), None]


def _middle(i, text):
    text = text or ""
    digest = _sha(f"1:{'' if i is None else i}")
    a, b, c, o = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return (i, n, "plain", None, None, text)
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    out = f"<P>{text[:lo]}<S>{text[hi:]}<M>{text[lo:hi]}" if o % 100 >= 20 else f"<S>{text[hi:]}<P>{text[:lo]}<M>{text[lo:hi]}"
    return (i, n, "psm" if o % 100 >= 20 else "spm", lo, hi - lo, out)


def test_fill_in_middle(spark):
    rng = random.Random(8)
    texts = [None, "", "a", "\n", "é漢😀́", "<", "<P", "S>", "<<S>>", "<M> inside", "x<P>y", "퟿\U0010ffff", "w" * 200_000]
    rows = [(k, "".join(rng.choice("ab<>PSM\n é😀") for _ in range(rng.randrange(40)))) for k in range(300)] + [(None, "no id"), (7, "other text of an id"), (7, "other text of an id")]
    rows += [(1000 + k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, form string").repartition(3)
    out = fill_in_middle.transformed(docs)
    expected = sorted((_middle(i, t) for i, t in rows), key=repr)
    assert sorted(map(tuple, out.collect()), key=repr) == expected
    assert {x[2] for x in expected} == {"plain", "psm", "spm"}
    digests = sorted(((r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in fill_in_middle.op13(docs).collect()), key=repr)
    assert digests == sorted(((i, _sha(_middle(i, t)[5]), _sha(t or "")) for i, t in rows), key=repr)
    assert fill_in_middle.op13(docs.where("false")).collect() == []


def test_units_of_words():
    """Other units: cuts fall behind words, and the matcher stops at the larger rank."""
    unit = re.compile(r"\S+")
    text = "  one two  three\nfour "
    assert fill_in_middle.count(unit, text) == 4
    assert [fill_in_middle.cuts(unit, text, a, b) for a, b in ((0, 0), (1, 3), (4, 4), (0, 2))] == [(0, 0), (5, 16), (21, 21), (0, 9)]
    policy = fill_in_middle.Policy(unit=r"\S+", plain=0)
    for k in range(50):
        n, form, prefix, middle, output = fill_in_middle.transform(text, str(k), unit, policy)
        assert n == 4 and fill_in_middle.restore(form, output) == text and (text + " ")[prefix] in " \n" + text[0]
