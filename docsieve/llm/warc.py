"""WARC archives of web pages, and a two-level capture index over them.

Archives: one gzip member a record, so that a record can be read by itself. Of records with equal payloads of at least
LEAST_REVISIT bytes, one is a response and the others are revisits that refer to it.

Index: captures are sorted by reversed-host key ("com,example)/path"). A sorted run of them is an index file: compressed blocks
of BLOCK lines, then a sparse directory with the first key of each block. The list of index files, a row for about a million
captures, is the upper level. A lookup searches the list, then a file's directory, both by bisection, and reads only the blocks of its key
and the ranges of its records.

Defined cases: a null payload is empty; a null URL has the key "-" and no target header. Empty tables give no files. Repeated
rows are records each; among equal payloads every row with the largest page_id is a response. Columns beside page_id, url and html
aren't read. Payloads of any size are kept whole.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm import files, shared

LEAST_REVISIT, BLOCK = 1000, 512
#: Bytes after which an archive is closed, captures after which an index file is closed, bytes read from an archive at a time.
ARCHIVE_BYTES, INDEX_CAPTURES, _READ_BYTES = 32 << 20, 1 << 20, 4 << 20
_FOOT = "<QQ4s"
_URL = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)")


def reversed_host(url: str | None) -> str:
    """The sort key of a URL: labels of the host from the last to the first, then path and query."""
    if not url:
        return "-"
    m = _URL.match(url.strip())
    if not m:
        return url.strip()
    _, host, port, path = m.groups()
    return ",".join(reversed(host.lower().rstrip(".").split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (path or "/")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record, not yet compressed. A revisit has the HTTP head and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's parts: page_id, url, record_type, refers_to, payload (None for a revisit), payload_bytes and payload_digest of the full payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    out = {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to"))}
    if out["record_type"] == "revisit":
        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return out | {"payload": None, "payload_bytes": size, "payload_digest": base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()}
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}


def write(pages: DataFrame, date: str = "2000-01-01T00:00:00Z", least: int = LEAST_REVISIT) -> DataFrame:
    """Writes the archives of a table (page_id, url, html). Returns the captures: (key, page_id, uri, offset, length), as a written table."""
    folder = shared.new_path(pages.sparkSession, "warc")
    files.make_folder(folder)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    alike = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    heads = shared.written(alike.select("digest", "head"), "heads")
    # Both sides are plain shuffles of one key, so a payload that very many pages share is split by adaptive execution.
    told = rows.join(heads, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("head") != F.coalesce("page_id", F.col("head") - 1), F.col("head")).alias("refers_to"))
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        rows: list[tuple] = []
        at = 0

        def close() -> pa.RecordBatch:
            nonlocal at
            uri = files.attempt_name(folder, ".warc.gz")
            files.write(uri, b"".join(held))
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([r[0] for r in rows], [r[1] for r in rows], [uri] * len(rows), [r[2] for r in rows], [r[3] for r in rows]), schema.types, strict=True)], schema=schema)
            held.clear()
            rows.clear()
            at = 0
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                member = gzip.compress(record(page_id, url, html.encode(), digest, refers_to, date), 4, mtime=0)
                rows.append((reversed_host(url), page_id, at, len(member)))
                held.append(member)
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    yield close()
        if held:
            yield close()

    return shared.written(told.mapInArrow(store, "key string, page_id long, uri string, offset long, length long"), "captures")


def build_index(captures: DataFrame, block: int = BLOCK) -> DataFrame:
    """Writes the index files of a table of captures. Returns the upper level, as a written table: (first_key, uri, n), a row an index file."""
    folder = shared.new_path(captures.sparkSession, "cdx")
    files.make_folder(folder)
    order = ["key", "page_id", "uri", "offset"]
    rows = captures.select("key", "page_id", "uri", "offset", "length").repartitionByRange("key", "page_id", "uri", "offset").sortWithinPartitions(*order)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[bytes] = []
        directory: list[list] = []
        lines: list[str] = []
        at, n = 0, 0

        def close_block() -> None:
            nonlocal at
            packed = zlib.compress("\n".join(lines).encode(), 6)
            directory.append([json.loads(lines[0])[0], at, len(packed)])
            blocks.append(packed)
            at += len(packed)
            lines.clear()

        def close() -> pa.RecordBatch:
            nonlocal at, n
            if lines:
                close_block()
            packed = zlib.compress(json.dumps(directory).encode(), 6)
            uri = files.attempt_name(folder, ".cdx")
            files.write(uri, b"".join([*blocks, packed, struct.pack(_FOOT, at, len(packed), b"CDX1")]))
            out = pa.RecordBatch.from_pydict({"first_key": [directory[0][0]], "uri": [uri], "n": [n]})
            blocks.clear()
            directory.clear()
            at, n = 0, 0
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(json.dumps(row))
                n += 1
                if len(lines) >= block:
                    close_block()
                if n >= INDEX_CAPTURES:
                    yield close()
        if n:
            yield close()

    return shared.written(rows.mapInArrow(store, "first_key string, uri string, n long"), "index")


class IndexFile:
    """An index file: its directory, and any of its blocks."""

    def __init__(self, uri: str):
        store, path = files.opened(uri)
        size = store.get_file_info(path).size
        foot = struct.calcsize(_FOOT)
        at, length, magic = struct.unpack(_FOOT, files.read_range(uri, size - foot, foot))
        if magic != b"CDX1":
            raise ValueError("not an index file")
        self.uri, self.directory = uri, json.loads(zlib.decompress(files.read_range(uri, at, length)))
        self._keys = [x[0] for x in self.directory]

    def block(self, k: int) -> list[list]:
        _, at, length = self.directory[k]
        return [json.loads(x) for x in zlib.decompress(files.read_range(self.uri, at, length)).decode().split("\n")]

    def captures(self, key: str) -> Iterator[list]:
        """The captures of a key: from the last block that begins before it on, while blocks can hold it."""
        k = max(0, bisect.bisect_left(self._keys, key) - 1)
        while k < len(self._keys) and self._keys[k] <= key:
            yield from (x for x in self.block(k) if x[0] == key)
            k += 1


_CAPTURE = "key string, page_id long, uri string, offset long, length long"
_CAPTURE_SCHEMA = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _captures(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _CAPTURE_SCHEMA.types, strict=True)], schema=_CAPTURE_SCHEMA)


def lookup(index: DataFrame, urls: DataFrame) -> DataFrame:
    """The captures of a table of URLs (url). The upper level, about a row a million captures, goes to every task."""
    top = sorted((r["first_key"], r["uri"]) for r in index.collect())
    firsts = [x[0] for x in top]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, IndexFile] | None = None
        for batch in batches:
            found: list[list] = []
            for key in sorted({reversed_host(u) for u in batch.column(0).to_pylist()}):
                k = max(0, bisect.bisect_left(firsts, key) - 1)
                while k < len(top) and firsts[k] <= key:
                    if not opened or opened[0] != top[k][1]:
                        opened = (top[k][1], IndexFile(top[k][1]))
                    found += opened[1].captures(key)
                    k += 1
            yield _captures(found)

    return urls.select(F.col("url").cast("string")).distinct().mapInArrow(search, _CAPTURE)


def all_captures(index: DataFrame) -> DataFrame:
    """Every capture, decoded from the index files' blocks."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                file = IndexFile(uri)
                for k in range(len(file.directory)):
                    yield _captures(file.block(k))

    return index.select("uri").repartition(index.sparkSession.sparkContext.defaultParallelism * 2, "uri").mapInArrow(load, _CAPTURE)


def read(captures: DataFrame) -> DataFrame:
    """The records of some captures, by range reads: page_id, url, record_type, refers_to, html (null for a revisit), payload_bytes, payload_digest."""
    # A task gets a stretch of an archive, in order, so that reads of neighbouring records are one.
    near = captures.select("uri", "offset", "length", F.floor(F.col("offset") / _READ_BYTES).alias("stretch"))
    rows = near.repartition("uri", "stretch").sortWithinPartitions("uri", "offset").drop("stretch")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            while todo:
                uri, begin, _ = todo[0]
                n = 0
                while n < len(todo) and todo[n][0] == uri and (n == 0 or todo[n][1] - begin < _READ_BYTES):
                    n += 1
                raw = files.read_range(uri, begin, todo[n - 1][1] + todo[n - 1][2] - begin)
                found = [parse(gzip.decompress(raw[at - begin : at - begin + size])) for _, at, size in todo[:n]]
                todo = todo[n:]
                column = lambda k, kind: pa.array([x[k] for x in found], kind)  # noqa: B023, E731
                text = pa.array([None if x["payload"] is None else x["payload"].decode() for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([column("page_id", pa.int64()), column("url", pa.string()), column("record_type", pa.string()), column("refers_to", pa.int64()), text, column("payload_bytes", pa.int64()), column("payload_digest", pa.string())], names=["page_id", "url", "record_type", "refers_to", "html", "payload_bytes", "payload_digest"])

    return rows.mapInArrow(load, "page_id long, url string, record_type string, refers_to long, html string, payload_bytes long, payload_digest string")


def op5(pages: DataFrame) -> DataFrame:
    """Archives a table (page_id, url, html), indexes the archives, and reads every record back through the index."""
    found = read(all_captures(build_index(write(pages))))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
