"""WARC records in ZIP-packaged archives, read by range without extraction.

An archive is a ZIP file whose members are stored, not deflated: a gzip member
per record in ``archive/data.warc.gz``, a line per record with its offset and
length in ``indexes/index.cdxj``, and ``datapackage.json``. The reader parses
the end record, the ZIP64 locator and end record, and the central directory,
finds the stored members and reads single records by offset; nothing else of
the file is touched. It works on any source with ``size`` and ``read_at``.

Archives are rows (archive, data) of a table of bounded files, written by
Spark's own committer to the shared folder, so a lost executor costs a task.

Records with equal payloads: that with the largest page_id is the response, the
others are revisits that refer to it and hold no payload.

Defined cases: null html is the empty payload; rows without page_id are
responses unless a row with an id has their payload; rows that repeat a
response's page_id and payload are responses too; an empty table makes no
archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._common import byte_text, materialize

ARCHIVE_BYTES = 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- ZIP reader -------------------------------------------------------------


class BytesSource:
    """Random access to bytes in memory."""

    def __init__(self, data: bytes):
        self.data, self.size = memoryview(data), len(data)

    def read_at(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError("a read beyond the end of the archive")
        return bytes(self.data[offset : offset + length])


class FileSource:
    """Random access to a file."""

    def __init__(self, path: str):
        self.file = open(path, "rb")
        self.size = self.file.seek(0, 2)

    def read_at(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError("a read beyond the end of the archive")
        self.file.seek(offset)
        return self.file.read(length)


class Member:
    def __init__(self, name: str, method: int, size: int, packed: int, header: int, crc: int):
        self.name, self.method, self.size, self.packed, self.header, self.crc = name, method, size, packed, header, crc


class ZipArchive:
    """The central directory of a ZIP or ZIP64 file."""

    def __init__(self, source):
        self.source = source
        tail_at = max(0, source.size - 65557)
        tail = source.read_at(tail_at, source.size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        # The comment may hold the signature: its length must reach the end.
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("not a ZIP file: no end record")
        count, size, offset = struct.unpack_from("<HII", tail, at + 10)
        where = tail_at + at
        if where >= 20:
            locator = source.read_at(where - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                end = source.read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end[:4] != b"PK\x06\x06":
                    raise ValueError("the ZIP64 end record is not where its locator says")
                count, size, offset = struct.unpack_from("<QQQ", end, 32)
        self.members: dict[str, Member] = {}
        directory, at = source.read_at(offset, size), 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("a wrong entry in the central directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            crc, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", directory, at + 16)
            header = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            full, packed, header = _zip64(extra, full, packed, header)
            self.members[name] = Member(name, method, full, packed, header, crc)
            at += 46 + n_name + n_extra + n_comment

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """Bytes of a stored member, by range."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is not stored: it can't be read by range")
        local = self.source.read_at(m.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        length = m.size - offset if length is None else length
        if offset + length > m.size:
            raise ValueError(f"a read beyond the end of {name}")
        return self.source.read_at(m.header + 30 + n_name + n_extra + offset, length)


def _zip64(extra: bytes, full: int, packed: int, header: int) -> tuple[int, int, int]:
    """Sizes and offset, where the short fields say they are in the ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            left = list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            full = left.pop(0) if full == 0xFFFFFFFF else full
            packed = left.pop(0) if packed == 0xFFFFFFFF else packed
            header = left.pop(0) if header == 0xFFFFFFFF else header
        at += 4 + n
    return full, packed, header


# --- records ----------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str | None) -> str:
    return "".join(c for c in value or "" if c >= " " and c != "\x7f")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit where ``refers_to`` is set."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; raises where length or digest don't match."""
    cut = raw.index(b"\r\n\r\n")
    first, *lines = raw[:cut].decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = raw[cut + 4 : cut + 4 + int(h["content-length"])]
    if len(block) != int(h["content-length"]) or raw[cut + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length does not match")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    kind = h["warc-type"]
    if kind == "response" and (payload_digest(payload) != digest or len(payload) != int(fields["content-length"])):
        raise ValueError("a payload's digest does not match")
    number = lambda v: int(v[len("<urn:page:") : -1]) if v and v != "<urn:page:>" else None
    return {
        "page_id": number(h["warc-record-id"]),
        "url": h["warc-target-uri"],
        "payload": payload if kind == "response" else None,
        "payload_bytes": int(fields["content-length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(h.get("warc-refers-to", "")),
    }


class ArchiveWriter:
    """One archive in memory, up to about ``ARCHIVE_BYTES``."""

    def __init__(self) -> None:
        self.data, self.index, self.at = [], [], 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        packed = gzip.compress(record(page_id, url, payload, refers_to), 3, mtime=0)
        entry = {"url": _clean(url), "id": page_id, "offset": self.at, "length": len(packed), "filename": "data.warc.gz"}
        self.index.append(f"{_clean(url)} {DATE} {json.dumps(entry)}")
        self.data.append(packed)
        self.at += len(packed)

    def close(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, body in ((DATA, b"".join(self.data)), (INDEX, "".join(x + "\n" for x in self.index).encode()), ("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())):
                z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), body)
        return out.getvalue()


def read_archive(source) -> Iterator[dict]:
    """Every indexed record, each by its own range."""
    z = ZipArchive(source)
    for line in z.read(INDEX).decode().splitlines():
        entry = json.loads(line[line.index("{") :])
        yield parse_record(zlib.decompress(z.read(DATA, entry["offset"], entry["length"]), 31))


# --- tables -----------------------------------------------------------------


def write_archives(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives (data) of all pages, written to the shared folder."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), byte_text("html").alias("b")).withColumn("sha", F.sha2("b", 256))
    # A table of its own, so that Spark can split the join where one payload
    # stands on very many pages.
    first = materialize(spark, rows.groupBy("sha").agg(F.max("page_id").alias("ref")), "payloads")
    typed = rows.join(first, "sha").select("page_id", "url", "b", F.when(~F.col("page_id").eqNullSafe(F.col("ref")), F.col("ref")).alias("ref"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = ArchiveWriter()
        emit = lambda w: pa.RecordBatch.from_arrays([pa.array([len(w.data)], pa.int64()), pa.array([w.close()], pa.binary())], names=["records", "data"])
        for b in batches:
            for page, url, body, ref in zip(*(c.to_pylist() for c in b.columns)):
                w.add(page, url, body, ref)
                if w.at >= ARCHIVE_BYTES:
                    yield emit(w)
                    w = ArchiveWriter()
        if w.data:
            yield emit(w)

    return materialize(spark, typed.mapInArrow(run, "records long, data binary"), "warc")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(archives: DataFrame) -> DataFrame:
    """A row per record of all archives, from range reads."""
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = list(read_archive(BytesSource(data.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.string() if n in ("payload_digest", "record_type") else pa.int64()) for n in names], names=names)

    return archives.select("data").mapInArrow(run, RECORDS)
