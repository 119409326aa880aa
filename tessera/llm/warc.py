"""WARC archives and a two-level capture index.

Archives hold one gzip member a record, so a record is one range read. The index sorts captures by reversed-host URL key
into compressed blocks; a sparse directory keeps each block's first key. A lookup finds the shard among the shards' key
ranges, the block by binary search in the shard's directory, and then range-reads the block and the records.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, read, small_batches
from tessera.llm.files import create, fresh, size_of, span

#: Payloads of fewer bytes are stored again and again; captures in one block of the index; bytes of one archive.
LEAST_REVISIT, BLOCK_LINES, ARCHIVE_BYTES = 1000, 2048, 128 << 20
#: Compressed bytes that one task reads back, about.
READ_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
_TAIL = "<QQ8s"
_MAGIC = b"CAPIDX01"
_ENTRY = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
                    ("length", pa.int64())])
_ENTRY_DDL = "key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """The sort key of a URL: host reversed, lower case and without www, then path and query; scheme, user, default
    port and fragment go. ``-`` for null."""
    if not url:
        return "-"
    m = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)", url)
    if not m:
        return quote(url, safe="/?&=:;,.%~+!$'()*@-_")
    host, _, port = m[2].lower().partition(":")
    host = re.sub(r"^www\d*\.", "", host)
    port = "" if port in ("", "80", "443") else f":{port}"
    return ",".join(reversed(host.split("."))) + port + ")" + quote(m[3] or "/", safe="/?&=:;,.%~+!$'()*@-_")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n: int, refers: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the headers only."""
    revisit = refers is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=''.join(map(chr, range(33, 127))))}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """What a record says of its page. A response's payload is hashed again; a revisit's digest is that of its header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda v: int(v[len("<urn:page:"):-1]) if v and v != "<urn:page:>" else None
    kind = fields["WARC-Type"]
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    out = {"page_id": number(fields["WARC-Record-ID"]), "record_type": kind, "payload": None,
           "refers_to": number(fields.get("WARC-Refers-To")),
           "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload_digest": stated}
    if kind == "response":
        out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
        if out["payload_digest"] != stated:
            raise ValueError(f"payload of page {out['page_id']} is damaged")
    return out


def _gzip(data: bytes, level: int = 5) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _archived(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, n, refers in zip(*(batch.column(i) for i in range(6)), strict=True):
                page_id, url = page_id.as_py(), url.as_py()
                data = _gzip(record(page_id, url, payload.as_py() or b"", digest.as_py(), n.as_py(), refers.as_py()))
                if out is None or at + len(data) > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    uri, at = fresh(folder, ".warc.gz"), 0
                    out = create(uri)
                out.write(data)
                rows.append({"key": url_key(url), "page_id": page_id, "file": uri, "offset": at, "length": len(data)})
                at += len(data)
            yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY)
        if out is not None:
            out.close()
    return run


def _indexed(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, at, held, firsts = fresh(folder, ".idx"), None, 0, [], []
        last = None

        def block():
            nonlocal at
            data = _gzip("\n".join(json.dumps(row, separators=(",", ":")) for row in held).encode())
            firsts.append((held[0][0], at, len(data)))
            out.write(data)
            at += len(data)
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    out = create(uri)
                held.append(row)
                last = row[0]
                if len(held) == BLOCK_LINES:
                    block()
        if out is not None:
            if held:
                block()
            directory = _gzip(json.dumps(firsts).encode())
            out.write(directory)
            out.write(struct.pack(_TAIL, at, len(directory), _MAGIC))
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": uri, "first": firsts[0][0], "last": last, "blocks": len(firsts)}])
    return run


@lru_cache(maxsize=4)
def directory(uri: str) -> list[list]:
    """A shard's sparse directory: the first key, offset and length of each block."""
    at, length, magic = struct.unpack(_TAIL, span(uri, size_of(uri) - struct.calcsize(_TAIL), struct.calcsize(_TAIL)))
    if magic != _MAGIC:
        raise ValueError(f"{uri} is not a capture index")
    return json.loads(zlib.decompress(span(uri, at, length), 31))


def block_rows(uri: str, offset: int, length: int) -> list[list]:
    return [json.loads(line) for line in zlib.decompress(span(uri, offset, length), 31).decode().split("\n")]


#: The block that a task asked last: keys come in order, so that each block is read about once.
_block = lru_cache(maxsize=2)(block_rows)


def find(uri: str, key: str) -> Iterator[list]:
    """A key's captures in one shard: binary search in the directory and in its blocks, which are read by ranges."""
    blocks = directory(uri)
    k = max(0, bisect.bisect_left(blocks, key, key=lambda b: b[0]) - 1)
    while k < len(blocks) and blocks[k][0] <= key:
        rows = _block(uri, blocks[k][1], blocks[k][2])
        at = bisect.bisect_left(rows, key, key=lambda row: row[0])
        while at < len(rows) and rows[at][0] == key:
            yield rows[at]
            at += 1
        k += 1


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            for _, offset, length in directory(uri):
                rows = block_rows(uri, offset, length)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ENTRY.types, strict=True)],
                                                 schema=_ENTRY)


def _records(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(c, types.get(c, pa.string())) for c in columns])
        for batch in batches:
            rows = []
            for uri, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                row = parsed(zlib.decompress(span(uri, offset, length), 31))
                rows.append({c: row[c] for c in columns})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return run


class Captures:
    """Archives and index of a table of pages, in a folder of the shared one."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.scratch = Scratch(spark, "warc")
        self.shards: DataFrame | None = None
        self.bytes = 0

    def write(self, pages: DataFrame) -> Captures:
        """``pages`` (page_id, url, html). Of records with equal payloads of at least LEAST_REVISIT bytes, that with the
        largest page_id is the response (each of them, if rows repeat it) and the others revisit it; a null id is never
        the largest unless all are null, and then all are responses. A null or empty html has an empty payload. A null
        url is written as urn:none and sorts under ``-``. Other columns are ignored; an empty table has no files.
        """
        small_batches(self.spark)
        payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
        rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                            payload.alias("payload"))
        rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
        first = rows.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(
            F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
        rows = rows.join(first.select("digest", "first"), "digest", "left")
        again = F.col("first").isNotNull() & (F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)))
        rows = rows.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", "n",
                           F.when(again, F.col("first")).alias("refers"))
        entries = self.scratch.table(rows.mapInArrow(_archived(f"{self.scratch.path}/archives"), _ENTRY_DDL), "entries")
        self.bytes = entries.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        order = ["key", F.col("page_id").asc_nulls_first(), "file", "offset"]
        self.shards = self.scratch.table(
            entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
                _indexed(f"{self.scratch.path}/index"), "shard string, first string, last string, blocks long"), "shards")
        return self

    def entries(self) -> DataFrame:
        """All captures, from the blocks of the index."""
        n = max(1, self.shards.count())  # a number keeps small rows that mean large reads apart
        return self.shards.select("shard").repartition(2 * n, "shard").mapInArrow(_entries, _ENTRY_DDL)

    def records(self, entries: DataFrame, payload: bool = False) -> DataFrame:
        """What the records of ``entries`` say, read by ranges in the order of the files."""
        columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
        ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.bytes // READ_BYTES))
        spans = F.floor(F.col("offset") / (READ_BYTES // 4))
        return entries.select("file", "offset", "length").repartition(parts, "file", spans).sortWithinPartitions(
            "file", "offset").mapInArrow(_records(columns), ddl + ", payload binary" * payload)

    def lookup(self, urls: DataFrame) -> DataFrame:
        """The captures of each row of ``urls`` (url): key, page_id, file, offset, length. The shards' key ranges are one
        row a shard; keys go to the shards that may hold them, each shard's directory to the tasks that ask it."""
        ranges = [tuple(r) for r in self.shards.select("first", "last", "shard").orderBy("first", "last").collect()]

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lasts = [last for _, last, _ in ranges]
            for batch in batches:
                rows = []
                for url in batch.column(0).to_pylist():
                    key = url_key(url)
                    k = bisect.bisect_left(lasts, key)
                    while k < len(ranges) and ranges[k][0] <= key:
                        rows.append({"shard": ranges[k][2], "key": key})
                        k += 1
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("shard", pa.string()), ("key", pa.string())]))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = (dict(zip(_ENTRY.names, row, strict=True)) for uri, key in zip(
                    *(batch.column(i).to_pylist() for i in range(2)), strict=True) for row in find(uri, key))
                while some := list(islice(rows, BLOCK_LINES)):
                    yield pa.RecordBatch.from_pylist(some, schema=_ENTRY)

        return urls.select("url").mapInArrow(route, "shard string, key string").distinct().repartitionByRange(
            "shard", "key").sortWithinPartitions("shard", "key").mapInArrow(ask, _ENTRY_DDL)


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a record for each page, then looks all of them up by their URLs."""
    pages = read(spark, sf_dir, "pages")
    captures = Captures(spark).write(pages)
    return captures.records(captures.lookup(pages))


OP1_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as payload_digest,
         strlen(coalesce(html, ''))::bigint as payload_bytes
  from pages),
f as (select html, max(page_id) as first from p where payload_bytes >= 1000 group by html)
select page_id, payload_bytes, payload_digest,
       case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
       case when first <> page_id then first end as refers_to
from p left join f on p.html = f.html
"""
