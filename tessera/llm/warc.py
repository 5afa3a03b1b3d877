"""WARC archives: one gzip member for each record, written and read back in sequence.

``write_archives`` makes archives of about ``roll_bytes`` (one row each: name,
content), stored by Spark in the shared folder, so that a lost task is simply run
again.  ``read_archives`` takes any (path, content) rows, also those of
``spark.read.format("binaryFile")`` over ``*.warc.gz``: it inflates a member
incrementally, frames header and payload by Content-Length and verifies the
payload digest.  ``export`` writes real files.

Of records with equal payloads of at least ``min_bytes`` bytes the smallest
record id is ``response``, the others are ``revisit`` records without payload
that refer to it.

Defined results: a null payload is empty; a null url becomes an empty target URI;
rows that repeat a page_id are separate records (all with the smallest id of
their payload are responses); a null page_id is read back as null and is never
referred to; an empty table gives no archive and no rows; extra columns are
ignored.  A record that is cut short, or whose digest is wrong, raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _store

#: An archive is closed once it holds this many bytes; a longer record gets an archive of its own.
ROLL_BYTES = 4 << 20
#: Inflated bytes taken at a time.
CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
RECORD_SCHEMA = "archive string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id: int | None, url: str, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One record as one gzip member; a revisit has no payload but the digest and length of the full one."""
    body = b"" if refers_to is not None else payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body))),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(body) + packer.compress(b"\r\n\r\n") + packer.flush()


class SequentialReader:
    """Yields (offset, headers, payload) from gzip members that follow one another in ``blocks``.

    Only the open record is inflated; ``blocks`` may split members anywhere.
    """

    def __init__(self, blocks: Iterable[bytes | memoryview]) -> None:
        self._blocks = iter(blocks)
        self._rest: bytes | memoryview = b""
        self.offset = 0

    def _more(self) -> bool:
        while not len(self._rest):
            block = next(self._blocks, None)
            if block is None:
                return False
            self._rest = memoryview(block)
        return True

    def __iter__(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        while self._more():
            began, inflate = self.offset, zlib.decompressobj(31)
            buffer, headers, need = bytearray(), None, 0
            while not inflate.eof:
                if not self._more():
                    raise ValueError(f"the record at {began} is cut short")
                piece = self._rest[:CHUNK]
                out = inflate.decompress(piece)
                taken = len(piece) - len(inflate.unused_data)
                self._rest, self.offset = self._rest[taken:], self.offset + taken
                buffer += out
                if headers is None and (end := buffer.find(b"\r\n\r\n")) >= 0:
                    first, *lines = buffer[:end].decode().split("\r\n")
                    if not first.startswith("WARC/"):
                        raise ValueError(f"no WARC record at {began}")
                    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                    need = int(headers["content-length"])
                    del buffer[: end + 4]
            if headers is None or len(buffer) != need + 4 or buffer[need:] != b"\r\n\r\n":
                raise ValueError(f"the record at {began} doesn't have the length its header gives")
            payload = bytes(buffer[:need])
            if headers["warc-type"] != "revisit" and headers.get("warc-payload-digest") != f"sha1:{digest(payload)}":
                raise ValueError(f"the payload at {began} doesn't match its digest")
            yield began, headers, payload


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with ``refers_to``: null for a response.

    Counts digests with partial sums, keeps those that occur more than once, and
    joins the small (page_id, digest) side; page texts move once, by page_id.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), body.alias("html"))
    keys = _store.materialize(pages.where("page_id is not null").select("page_id", F.unhex(F.sha1("html")).alias("sha")).where(F.octet_length("html") >= min_bytes), "digests")
    first = keys.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = _store.materialize(first, "first")
    later = keys.join(first, "sha").where("page_id <> first").select("page_id", "sha", F.col("first").alias("refers_to")).distinct()
    return pages.withColumn("sha", F.unhex(F.sha1("html"))).join(later, ["page_id", "sha"], "left").drop("sha")


def _pack(batches: Iterator[pa.RecordBatch], roll_bytes: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("content", pa.binary())])
    held = bytearray()
    for batch in batches:
        for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
            payload = html.as_buffer().to_pybytes() if html.is_valid else b""
            record = encode_record(page_id.as_py(), url.as_py(), payload, digest(payload), refers_to.as_py())
            if held and len(held) + len(record) > roll_bytes:
                yield pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], schema=schema)
                held = bytearray()
            held += record
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], schema=schema)


def write_archives(planned: DataFrame, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """(path, content) of the archives that hold the planned records, written as a table in the shared folder."""
    packed = planned.select("page_id", "url", "html", "refers_to").mapInArrow(lambda it: _pack(it, roll_bytes), "content binary")
    named = packed.select(F.format_string("part-%012d.warc.gz", F.monotonically_increasing_id()).alias("path"), "content")
    return _store.materialize(named, "warc")


def _unpack(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    ident = lambda s: int(s[len("<urn:page:") : -1]) if s and len(s) > len("<urn:page:>") else None
    for batch in batches:
        for path, content in zip(*batch.columns, strict=True):
            rows, size = [], 0
            for offset, h, payload in SequentialReader([memoryview(content.as_buffer())]):
                rows.append((path.as_py(), offset, ident(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], ident(h.get("warc-refers-to")), int(h["warc-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), payload if with_payload else None))
                size += len(payload) if with_payload else 0
                if size > 8 << 20 or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of (path, content) rows, each archive read in sequence."""
    return archives.select("path", "content").mapInArrow(lambda it: _unpack(it, with_payload), RECORD_SCHEMA)


def read_files(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the ``*.warc.gz`` files under a path of any file system that Spark reads."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path), with_payload)


def export(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file into a folder that driver and executors share; a retried task overwrites its own files."""
    os.makedirs(folder, exist_ok=True)

    def save(rows) -> None:
        for row in rows:
            part = os.path.join(folder, f".{row.path}.{os.getpid()}")
            with open(part, "wb") as f:
                f.write(row.content)
            os.replace(part, os.path.join(folder, row.path))

    archives.foreachPartition(save)


def warc_query(pages: DataFrame) -> DataFrame:
    """Write a record for each page, read the archives back: the contract's digest of the records."""
    records = read_archives(write_archives(plan_records(pages)), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
