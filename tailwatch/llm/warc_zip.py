"""WARC records in ZIP packages: written by tasks, and read back by ranges, without extraction.

A package holds ``archive/data.warc.gz``, one gzip member for each record, and ``indexes/index.txt``, a line of offset and
length for each; both are stored as they are. The reader takes the end of central directory (or its ZIP64 form) from the
file's tail, the members from the central directory, the data's place from the local header, and the record ranges from
the index; ranges are then dealt to tasks, which fetch and parse them. Nothing reads a package whole.

Records of equal payload: the one of the smallest key is a response, the others are revisits that refer to it and keep
its HTTP headers, not its payload.

Defined results: null payloads are empty, and empty payloads are compared like others; rows with a null key are responses;
rows that repeat the smallest key are responses too; null addresses leave out the target header; an empty table writes no
package and reads as none. Keys are integers. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from . import store

#: A package is closed at this size; record ranges up to the second are fetched at once.
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.txt"
DATE = "2024-01-01T00:00:00Z"
RECORD_ID = "urn:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_first(pages: DataFrame, key: str, payload: str, url: str) -> DataFrame:
    """key, url, payload as bytes, and first: the smallest key of an equal payload, where there is another."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    keyed = rows.select("key", F.sha1("payload").alias("sha"))
    shared = pin(keyed.groupBy("sha").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("sha", "first"))
    return rows.withColumn("sha", F.sha1("payload")).join(shared, "sha", "left").select("key", "url", "payload", "first")


def record(key: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One record. A revisit's block ends after the HTTP headers; their Content-Length still tells the payload's size."""
    revisit = first is not None and key is not None and key > first
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if key is None else str(key)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{RECORD_ID}{name}>", f"WARC-Date: {DATE}",
            "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD_ID}{first}>"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Package:
    """A package being written; the index waits in memory, a few bytes a record."""

    def __init__(self, folder: str):
        self.address = f"{folder}/{uuid.uuid4().hex}.wacz"
        self.stream = store.create(self.address)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index, self.bytes = [], 0

    def add(self, content: bytes) -> None:
        packed = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packed.compress(content) + packed.flush()
        self.data.write(member)
        self.index.append(f"{self.bytes} {len(member)}\n")
        self.bytes += len(member)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.index))
        self.zip.close()
        self.stream.close()
        return self.address, len(self.index), self.bytes


def write_packages(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """Write packages into a shared folder; returns the stored list of them (address, records, bytes).

    The list names what finished tasks wrote, so packages that a lost task left behind are never read.
    """
    store.make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                package = package or _Package(folder)
                package.add(record(*row))
                if package.bytes >= PACKAGE_BYTES:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["address", "records", "bytes"])

    return pin(with_first(pages, key, payload, url).mapInArrow(write, "address string, records long, bytes long"))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    header: int
    size: int


def _at(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)


def directory(file, size: int) -> dict[str, Member]:
    """Members by name, from the central directory or its ZIP64 form."""
    tail_at = max(0, size - 65557)
    tail = _at(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack_from("<H2I", tail, end + 10)
    locator = _at(file, tail_at + end - 20, 20) if tail_at + end >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        record64 = _at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory where its locator points")
        count, length, offset = struct.unpack_from("<3Q", record64, 32)
    entries, at, out = _at(file, offset, length), 0, {}
    for _ in range(count):
        if entries[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<2H", entries, at + 8)
        packed, plain, name_n, extra_n, note_n = struct.unpack_from("<2I3H", entries, at + 20)
        header = struct.unpack_from("<I", entries, at + 42)[0]
        name = entries[at + 46:at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = entries[at + 46 + name_n:at + 46 + name_n + extra_n]
        wide, place = _zip64(extra), 0
        # the ZIP64 field holds only the values that do not fit, in this order
        values = []
        for v in (plain, packed, header):
            if v == 0xFFFFFFFF and wide is not None:
                v = struct.unpack_from("<Q", wide, place)[0]
                place += 8
            values.append(v)
        out[name] = Member(name, method, values[2], values[1])
        at += 46 + name_n + extra_n + note_n
    return out


def _zip64(extra: bytes) -> bytes | None:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            return extra[at + 4:at + 4 + n]
        at += 4 + n
    return None


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin: after its local header, whose extra field may differ in length."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by ranges")
    local = _at(file, member.header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("no local header where the directory points")
    return member.header + 30 + sum(struct.unpack_from("<2H", local, 26))


def parse(content: bytes) -> dict:
    """A record's fields. Response payloads are held against their digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:])["Content-Length"])
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (digest(payload) != told or len(payload) != stated):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda x: int(x[1:-1].removeprefix(RECORD_ID)) if x and x[1:-1] != RECORD_ID else None
    return {"key": number(fields["WARC-Record-ID"]), "payload_bytes": stated, "payload_digest": told, "record_type": fields["WARC-Type"],
            "refers_to": number(fields.get("WARC-Refers-To")), "url": fields.get("WARC-Target-URI"), "payload": payload if fields["WARC-Type"] == "response" else None}


FIELDS = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_packages(packages: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Records of the listed packages. ``columns``: those of FIELDS to return; payloads that nobody asks for are checked
    and dropped where they are read."""
    wanted = columns or [f.split()[0] for f in FIELDS.split(", ")]
    types = dict(f.split() for f in FIELDS.split(", "))
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column(0).to_pylist():
                file, size = store.open_ranges(address)
                members = directory(file, size)
                start = data_start(file, members[DATA])
                lines = _at(file, data_start(file, members[INDEX]), members[INDEX].size).split(b"\n")[:-1]
                out, first, end = [], None, 0
                for a, n in (map(int, x.split()) for x in lines):
                    if first is None or end + n - first > RANGE_BYTES:
                        if first is not None:
                            out.append((address, start + first, end - first))
                        first = a
                    end = a + n
                if first is not None:
                    out.append((address, start + first, end - first))
                file.close()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["address", "at", "bytes"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, _ = store.open_ranges(address)
                data, found = _at(file, at, n), []
                file.close()
                while data:
                    member = zlib.decompressobj(31)
                    found.append(parse(member.decompress(data) + member.flush()))
                    data = member.unused_data
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], arrow[types[c]]) for c in wanted], wanted)

    parts = max(packages.sparkSession.sparkContext.defaultParallelism, 1) * 4
    spans = packages.select("address").repartition(parts).mapInArrow(ranges, "address string, at long, bytes long")
    return spans.repartition(parts).mapInArrow(records, ", ".join(f"{c} {types[c]}" for c in wanted))
