"""WARC archives as a chunked record table.

An archive is a table of chunk rows: archive, record number, chunk number,
bytes. The bytes of an archive's chunks, in order, are a WARC/1.1 file. A large
payload is streamed as many rows of bounded size, and every row carries the
SHA-1 of the payload so far, so that neither writer nor reader ever holds a
copy of a whole record beside the value it was given.

The table is kept by Spark's own writer, so archives can lie in any store that
Spark reaches and a lost executor's part is written again.

Records with equal payloads of at least ``revisit_bytes`` are written once: the
one with the largest id is a response, the others are revisits of it.

Defined results: a null payload is empty; a null id or address is written as
absent and read back as null; an address is written as a URI, other characters
than printable ASCII percent-encoded, and read back so; smaller equal payloads
are all responses; rows that repeat an id and payload are all revisits of the
largest id, or all responses where that is theirs (and then bear one record
name); columns besides id, address and payload are left out; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._shared import scratch, table

CHUNK = 64 << 10
REVISIT_BYTES = 1000
END = b"\r\n\r\n"
#: Headers that hold page ids, beside those of the standard.
PAGE, PAGE_REFERRED = "X-Page-ID", "X-Refers-To-Page-ID"
#: ASCII that stands in a target URI as it is; all else is percent-encoded.
_URI = "".join(map(chr, range(0x21, 0x7F)))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "archive int, record long, id long, chunk int, last boolean, body binary, payload_at int, payload_sha1 string"


def plan_records(pages: DataFrame, page_id: str, url: str, payload: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``id, url, body`` of each page, and what its record will be: ``digest, size, referred, refers_to``.

    Digests are counted, with their largest id, on the side of each task first,
    so a payload that a third of all pages share is one row of the smaller side
    of the join with the pages; adaptive execution splits the larger side.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    named = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), body.alias("body"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    groups = (
        named.filter(F.col("size") >= revisit_bytes)
        .groupBy("digest", "size")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("first_id"))
        .filter("n > 1")
        .select(F.col("digest").alias("d"), F.col("size").alias("s"), "first_id")
    )
    joined = named.join(groups, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    referred = F.col("first_id").isNotNull() & F.col("id").eqNullSafe(F.col("first_id"))
    return joined.select("id", "url", "body", "digest", "size", referred.alias("referred"), F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def record_name(*parts) -> str:
    """A record's identifier, the same whenever it is written."""
    return uuid.uuid5(uuid.NAMESPACE_URL, "\0".join(map(str, parts))).urn


def _head(kind: str, name: str, record_id, url, digest: str, size: int, refers_to) -> bytes:
    """The WARC and HTTP headers of a record, up to its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = len(http) + (size if kind == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    lines.append(f"WARC-Record-ID: <{name}>")
    if record_id is not None:
        lines.append(f"{PAGE}: {record_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=_URI, errors="surrogatepass"))
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_name(refers_to, digest)}>", f"{PAGE_REFERRED}: {refers_to}"]
    lines.append(f"Content-Length: {block}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + http


def write_archives(records: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Writes planned records as a chunked record table; one archive per task."""
    from pyspark import TaskContext

    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.string()]

    def chunks(row, *place) -> Iterator[tuple]:
        record_id, url, body, digest, size, referred, refers_to = row
        kind = "response" if refers_to is None else "revisit"
        # Only a record that others refer to must be found by its page.
        head = _head(kind, record_name(record_id, digest) if referred else record_name(*place, record_id, digest), record_id, url, digest, size, refers_to)
        body = memoryview(body) if kind == "response" else memoryview(b"")
        sha, at, number = hashlib.sha1(usedforsecurity=False), 0, 0
        while True:
            part = body[at : at + chunk]
            at += len(part)
            sha.update(part)
            done = at >= len(body)
            yield number, done, b"".join((head if number == 0 else b"", part, END if done else b"")), len(head) if number == 0 else 0, sha.hexdigest()
            if done:
                return
            number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, record = TaskContext.get().partitionId(), 0
        made: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(_values(batch.column(i)) for i in range(7)), strict=True):
                for number, done, body, at, sha in chunks(row, archive, record):
                    made.append((archive, record, row[0], number, done, body, at, sha))
                    held += len(body)
                    if held >= 64 * CHUNK:
                        yield _batch(made, names, kinds)
                        made, held = [], 0
                record += 1
        yield _batch(made, names, kinds)

    records.select("id", "url", "body", "digest", "size", "referred", "refers_to").mapInArrow(run, RECORD_SCHEMA).write.option("compression", "zstd").parquet(path)


def _values(column: pa.Array) -> Iterator:
    for x in column:
        if pa.types.is_binary(x.type):
            yield x.as_buffer() if x.is_valid else b""
        else:
            yield x.as_py()


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=names)


READ_SCHEMA = "archive int, record long, id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, stated_digest string, whole boolean"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from the bytes of its chunks.

    Chunks of one record are streamed in order through one task, which keeps a
    running SHA-1 and byte count only. ``whole`` tells whether the content
    length, the end mark and, for responses, the digest agree with the headers.
    """
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reader | None = None
        for batch in batches:
            made = []
            for archive, record, chunk, body in zip(*(_values(batch.column(i)) for i in range(4)), strict=True):
                if chunk == 0:
                    if now is not None:
                        made.append(now.row())
                    now = _Reader(archive, record, memoryview(body))
                else:
                    now.add(memoryview(body))
            yield _batch(made, names, kinds)
        if now is not None:
            yield _batch([now.row()], names, kinds)

    rows = spark.read.parquet(path).select("archive", "record", "chunk", "body", "last")
    columns = ("archive", "record", "chunk", "body")
    single = rows.filter("chunk = 0 AND last").select(*columns)
    parts = rows.filter("NOT (chunk = 0 AND last)").select(*columns)
    parts = parts.repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return single.mapInArrow(run, READ_SCHEMA).unionByName(parts.mapInArrow(run, READ_SCHEMA))


class _Reader:
    """Parses a record's headers from its first chunk and follows its payload."""

    def __init__(self, archive: int, record: int, first: memoryview):
        head, _, _ = bytes(first[: 16 << 10]).partition(b"\r\n\r\n")
        if len(head) == len(first[: 16 << 10]):
            head, _, _ = bytes(first).partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        self.fields = dict(x.split(": ", 1) for x in lines[1:])
        self.at = (archive, record)
        after = len(head) + 4
        http, _, _ = bytes(first[after : after + 1024]).partition(b"\r\n\r\n")
        stated = dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:])
        self.stated_size = int(stated["Content-Length"])
        self.left = int(self.fields["Content-Length"]) - len(http) - 4
        self.size, self.sha, self.tail = 0, hashlib.sha1(usedforsecurity=False), b""
        self.add(first[after + len(http) + 4 :])

    def add(self, part: memoryview) -> None:
        take = min(self.left, len(part))
        self.sha.update(part[:take])
        self.size += take
        self.left -= take
        self.tail += bytes(part[take:])

    def row(self) -> tuple:
        kind = self.fields["WARC-Type"]
        number = lambda name: int(self.fields[name]) if name in self.fields else None
        stated = self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        response = kind == "response"
        digest = self.sha.hexdigest() if response else stated
        whole = self.left == 0 and self.tail == END and digest == stated and (not response or self.size == self.stated_size)
        return (*self.at, number(PAGE), kind, number(PAGE_REFERRED), self.fields.get("WARC-Target-URI"), self.size if response else self.stated_size, digest, stated, whole)


def export_archive(spark: SparkSession, path: str, archive: int, to: str) -> int:
    """Streams one archive's bytes, chunk by chunk, into a ``.warc`` file; returns its size."""
    rows = spark.read.parquet(path).filter(F.col("archive") == archive).orderBy("record", "chunk").select("body")
    with open(to, "wb") as out:
        return sum(out.write(r[0]) for r in rows.toLocalIterator())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{scratch(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(plan_records(table(spark, sf_dir, "pages"), "page_id", "url", "html"), path)
    return read_archives(spark, path).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "whole"
    )
