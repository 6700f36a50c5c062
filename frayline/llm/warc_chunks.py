"""WARC archives as a chunked record table.

A record is stored as rows of its identifier, a chunk number and at most ``chunk_bytes``
bytes; put together in order, the rows of an archive are a WARC 1.1 file.  Writer and
reader pass over the chunks with a running SHA-1, so the reader never holds more than a chunk
of a record and the writer no more than the source's own row, which Spark hands over whole;
every row carries the digest up to its end.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable

CHUNK_BYTES = 1 << 16
#: Payloads of fewer bytes are never stored as revisits.
MIN_REVISIT_BYTES = 0
#: Copies of one payload are looked up in so many parts, so that a payload of very many copies is not one task's work.
PARTS = 16
#: All records bear one date, so that equal input gives equal archives.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = "archive int, record_id string, chunk_no long, data binary, running_sha1 binary"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_uri(page_id: int | None, row_no: int) -> str:
    """A stable identifier: of the page and, so that repeated rows stay apart, of the row."""
    h = hashlib.sha1(f"{page_id}/{row_no}".encode()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


def _header(kind: str, uri: str, url: str, page_id, size: int, digest: str, refers_to, refers_url) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{uri}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if kind == 'response' else 0)}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To-Target-URI: {refers_url}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write_archives(
    pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """The chunk rows of one WARC record for each row of ``pages``.

    The payload is the text in UTF-8 (null: empty).  Among records with equal payloads of at
    least ``min_revisit_bytes`` bytes, the one of the largest id (null ids rank below all) is
    a response; rows that repeat this id are responses too; the others are revisits without a
    payload.  A very long payload is cut into chunks where its row is; its own row is the only
    thing held whole.  Copies are found by digest in ``PARTS`` salted parts, which Spark splits
    further where they are large.  An empty table gives no rows; further columns of any name
    are ignored; line breaks in a url are removed.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "[\r\n]", "").alias("url"),
        F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long"), "part": F.pmod(F.xxhash64("page_id"), F.lit(PARTS)).cast("int")})
    kept = rows.select("digest", "size", F.struct("page_id", "url").alias("page")).where(F.col("size") >= min_revisit_bytes)
    kept = kept.groupBy("digest").agg(F.count("*").alias("copies"), F.max("page").alias("keeper")).where("copies > 1")
    # written first: where few payloads have copies, Spark sees that and moves no payload to find them
    kept = durable(kept, "warc-copies").select("digest", "keeper", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    rows = rows.join(kept, ["digest", "part"], "left").select("page_id", "url", "payload", "keeper.page_id", "keeper.url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = TaskContext.get().partitionId()
        row_no = 0
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, keeper, keeper_url = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4))
                payload = memoryview(batch.column(2)[i].as_buffer())
                uri = record_uri(page_id, archive << 33 | row_no)
                row_no += 1
                kind = "revisit" if keeper is not None and keeper != page_id else "response"
                running = hashlib.sha1()
                for at in range(0, len(payload), chunk_bytes):
                    running.update(payload[at : at + chunk_bytes])
                head = _header(kind, uri, url, page_id, len(payload), base32_sha1(running.digest()), keeper, keeper_url)
                running, body = hashlib.sha1(), payload if kind == "response" else payload[:0]
                pieces = [head, *(bytes(body[at : at + chunk_bytes]) for at in range(0, len(body), chunk_bytes)), b"\r\n\r\n"] if len(body) > chunk_bytes else [head, bytes(body) + b"\r\n\r\n"]
                for number, piece in enumerate(pieces):
                    running.update(piece)
                    out.append((archive, uri, number, piece, running.digest()))
                    held += len(piece)
                    if held > 4 << 20:
                        yield _rows(out)
                        out, held = [], 0
        if out:
            yield _rows(out)

    return rows.toDF("page_id", "url", "payload", "keeper", "keeper_url").mapInArrow(run, CHUNKS)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["archive", "record_id", "chunk_no", "data", "running_sha1"])


_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)\r?$", re.M)


class _Reader:
    """Reads one record chunk by chunk; holds its headers, never its payload."""

    def __init__(self, uri: str):
        self.uri, self.head, self.fields = uri, b"", None
        self.left = self.payload_bytes = 0
        self.payload, self.running = hashlib.sha1(), hashlib.sha1()
        self.ok = True

    def feed(self, data: bytes, expected: bytes) -> None:
        self.running.update(data)
        self.ok &= self.running.digest() == expected
        if self.fields is None:
            self.head += data
            data = self._parse()
        take = data[: self.left]
        self.left -= len(take)
        self.payload_bytes += len(take)
        self.payload.update(take)

    def _parse(self) -> bytes:
        end = self.head.find(b"\r\n\r\n")
        http_end = self.head.find(b"\r\n\r\n", end + 4)
        if end < 0 or http_end < 0:
            return b""
        warc, http, rest = self.head[:end], self.head[end + 4 : http_end], self.head[http_end + 4 :]
        self.fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(warc)}
        self.http = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(http)}
        self.left = int(self.fields["content-length"]) - (http_end + 4 - end - 4)
        self.head = b""
        return rest

    def row(self) -> tuple:
        f = self.fields or {}
        response = f.get("warc-type") == "response"
        stated = f.get("warc-payload-digest", "").removeprefix("sha1:")
        number = lambda x: int(x) if x else None
        digest = base32_sha1(self.payload.digest()) if response else stated
        refers = f.get("x-refers-to-page-id")
        whole = self.ok and self.fields is not None and self.left == 0 and digest == stated
        size = self.payload_bytes if response else int(self.http["content-length"]) if self.fields else 0
        return self.uri, number(f.get("x-page-id")), f.get("warc-target-uri"), f.get("warc-type"), size, digest, number(refers) if refers != "None" else None, whole


def read_archives(chunks: DataFrame) -> DataFrame:
    """One row for each record of a chunk table: the fields, size and digest of its payload, and whether all digests hold.

    Chunks come to the reader in the order of (record_id, chunk_no), whatever their order in
    the table; a record's digest is taken over its chunks in passing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                uri = batch.column(0)[i].as_py()
                if reader is None or reader.uri != uri:
                    if reader is not None:
                        out.append(reader.row())
                    reader = _Reader(uri)
                reader.feed(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
            if len(out) >= 4096:
                yield _records(out)
                out = []
        if reader is not None:
            out.append(reader.row())
        if out:
            yield _records(out)

    ordered = chunks.select("record_id", "chunk_no", "data", "running_sha1").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return ordered.mapInArrow(run, "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean")


def _records(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ["record_id", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "intact"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)


def archive_and_read(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the archives of all pages to the shared folder, then read them back."""
    chunks = durable(write_archives(pages, chunk_bytes, min_revisit_bytes, id_col, url_col, payload_col), "warc")
    return read_archives(chunks)


def export_archive(chunks: DataFrame, archive: int, path: str) -> int:
    """Stream one archive of a chunk table to a local .warc file, chunk by chunk; returns its bytes."""
    rows, total = chunks.where(F.col("archive") == archive).orderBy("record_id", "chunk_no").toLocalIterator(), 0
    with open(path, "wb") as f:
        for row in rows:
            total += f.write(row["data"])
    return total
