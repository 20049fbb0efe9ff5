"""Web archives in ZIP packages: written as stored members, read by ranges through their directories and indexes.

A package holds ``archive/data.warc.gz`` (one gzip member for each record), ``indexes/index.cdxj`` (a
sorted line for each record with its offset and length) and ``datapackage.json``, all stored, not
compressed again, so that a record is a range of bytes of the package. Sizes beyond 4 GiB and more than
65,535 members go through the ZIP64 fields.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.common import frugal, open_fs, partitions, pick

ARCHIVE, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:x-row:"
#: Bytes of a package after which a task begins another one, and of one range read.
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20


class Member(NamedTuple):
    name: str
    method: int
    offset: int
    size: int


# ---- writing


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: of rows with equal payloads of at least ``min_bytes``, which one the others revisit.

    That is the largest ``page_id``; ``refers_to`` is null for it, for rows whose payload is unlike all
    others or shorter, and for all rows that share the largest id. Rows without an id refer to the largest
    id there is, and to nothing if there is none. A null payload is empty.
    """
    rows = pick(pages, page_id="page_id", url="url", html="html")
    rows = rows.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    first = first.where("n > 1 and first_id is not null").select("digest", "first_id")
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "payload",
        F.when(F.col("page_id").eqNullSafe(F.col("first_id")), None).otherwise(F.col("first_id")).alias("refers_to"),
    )


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str, str]:
    """One record, its id and its payload's digest; a revisit has the headers of the answer, but no payload."""
    digest = payload_digest(payload)
    record_id = f"{RECORD}{page_id}" if page_id is not None else uuid.uuid4().urn
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: <{RECORD}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", record_id, digest


def sort_key(url: str | None) -> str:
    """Key of an index line: host labels from the top down, then the path; no blanks."""
    m = re.match(r"[a-z]+://([^/:?#]*)[^/?#]*(.*)", url or "", re.I | re.S)
    return "-" if not m else re.sub(r"\s", "%20", _clean(",".join(reversed(m[1].lower().split("."))) + ")" + m[2]))


class _PackageWriter:
    def __init__(self, folder: str, date: str, zip64: bool):
        self.path = f"{folder}/pages-{uuid.uuid4().hex}.wacz"  # a new name for each attempt
        fs, at = open_fs(self.path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.date, self.zip64, self.lines, self.bytes = date, zip64, [], 0
        self.out = fs.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)

    def add(self, page_id, url, payload, refers_to) -> None:
        record, record_id, digest = warc_record(page_id, url, payload, refers_to, self.date)
        data = gzip.compress(record, 6, mtime=0)
        entry = {"url": url, "digest": f"sha1:{digest}", "offset": self.bytes, "length": len(data), "filename": ARCHIVE, "record": record_id}
        entry["mime"] = "text/html" if refers_to is None else "warc/revisit"
        self.lines.append(f"{sort_key(url)} {re.sub('[^0-9]', '', self.date)} {json.dumps(entry)}\n")
        self.member.write(data)
        self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=self.zip64) as f:
            for line in sorted(self.lines):
                f.write(line.encode())
        self.zip.writestr(PACKAGE, json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE, "bytes": self.bytes}, {"path": INDEX}]}))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines), self.bytes


def write_packages(rows: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write ``page_id, url, payload, refers_to`` as packages; the manifest ``path, n_records, n_bytes``.

    Only packages of tasks that ended well are in the manifest, which must be written before it is read
    twice: each evaluation writes its own packages.
    """

    def run(batches):
        writer, done = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    writer = writer or _PackageWriter(folder, date, False)
                    writer.add(*row)
                    if writer.bytes >= package_bytes:
                        done.append(writer.close())
                        writer = None
        if writer:
            done.append(writer.close())
        columns = list(zip(*done, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, [pa.string(), pa.int64(), pa.int64()], strict=True)], ["path", "n_records", "n_bytes"])

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(frugal(run), "path string, n_records long, n_bytes long")


# ---- reading


def members(f, size: int) -> list[Member]:
    """The central directory of a ZIP file that can be read by ranges: ``f.read_at(n, offset)``."""
    tail = f.read_at(min(size, 22 + 65535), max(0, size - 22 - 65535))
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)  # the mark may also occur in the comment
    if at < 0:
        raise ValueError("no end of a central directory: this is no ZIP file, or it was cut")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    end = max(0, size - 22 - 65535) + at
    if end >= 20 and (locator := f.read_at(20, end - 20))[:4] == b"PK\x06\x07":
        where = struct.unpack_from("<Q", locator, 8)[0]
        record = f.read_at(56, where)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator points to no ZIP64 record")
        count, length, offset = struct.unpack_from("<QQQ", record, 32)
    directory, p, found = f.read_at(length, offset), 0, []
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        packed, plain, n, m, k = struct.unpack_from("<IIHHH", directory, p + 20)
        local = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            tag, bytes_ = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # ZIP64: only the fields that are full in the entry, in this order
                values = iter(struct.unpack_from(f"<{bytes_ // 8}Q", extra, q + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            q += 4 + bytes_
        found.append(Member(name, method, local, packed))
        p += 46 + n + m + k
    return found


def data_offset(f, member: Member) -> int:
    """Where the bytes of a member begin, behind its local header."""
    header = f.read_at(30, member.offset)
    if header[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no local header")
    return member.offset + 30 + sum(struct.unpack_from("<HH", header, 26))


class _Span(io.RawIOBase):
    """A range of a file as a stream."""

    def __init__(self, f, offset: int, size: int):
        self.f, self.at, self.end = f, offset, offset + size

    def readable(self):
        return True

    def readinto(self, buffer):
        data = self.f.read_at(min(len(buffer), self.end - self.at), self.at) if self.at < self.end else b""
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


def ranges(path: str, range_bytes: int = RANGE_BYTES) -> Iterator[tuple[str, bool, int, int]]:
    """Ranges of whole records in the package: path, whether they are gzip, offset, size.

    They follow the package's index; a stored archive that no index names is one range.
    """
    fs, at = open_fs(path)
    with fs.open_input_file(at) as f:
        found = members(f, f.size())
        archives = {m.name: m for m in found if re.search(r"\.warc(\.gz)?$", m.name)}
        for m in [*archives.values(), *(x for x in found if x.name.startswith("indexes/"))]:
            if m.method:
                raise ValueError(f"{m.name} in {path} isn't stored, so its records can't be read by ranges")
        entries: dict[str, list[tuple[int, int]]] = {}
        for m in found:
            if m.name.startswith("indexes/") and m.name.endswith(".cdxj"):
                for line in io.BufferedReader(_Span(f, data_offset(f, m), m.size), 1 << 20):
                    x = json.loads(line.split(b" ", 2)[2])
                    name = x["filename"] if x["filename"] in archives else "archive/" + x["filename"]
                    entries.setdefault(name, []).append((int(x["offset"]), int(x["length"])))
        for name, m in archives.items():
            base, zipped = data_offset(f, m), name.endswith(".gz")
            if name not in entries:
                yield path, zipped, base, m.size
                continue
            begin = end = None
            for offset, length in sorted(set(entries[name])):
                if begin is not None and (offset != end or end - begin >= range_bytes):
                    yield path, zipped, base + begin, end - begin
                    begin = None
                begin = offset if begin is None else begin
                end = offset + length
            if begin is not None:
                yield path, zipped, base + begin, end - begin


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record begins with {line[:20]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record was cut")
        yield headers, block


def _bare(uri: str | None) -> str | None:
    return None if uri is None else uri.removeprefix("<").removesuffix(">")


def read_packages(paths: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the packages in column ``path``: ``record_id, record_type, target_uri, refers_to, digest, payload_bytes, payload``.

    ``digest`` and ``payload_bytes`` of a response come from the payload as read; one that differs from
    the record's own digest ends the job. Those of a revisit, which has no payload (null), are the record's.
    """

    def locate(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = list(ranges(path, range_bytes))
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.string(), pa.bool_(), pa.int64(), pa.int64()], strict=True)], ["path", "zipped", "offset", "size"])

    def read(batches):
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["record_id", "record_type", "target_uri", "refers_to", "digest", "payload_bytes", "payload"]
        rows, held = [], 0

        def made():
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for path, zipped, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = open_fs(path)
                with fs.open_input_file(at) as f:
                    stream = io.BufferedReader(_Span(f, offset, size), min(max(size, 1), RANGE_BYTES))
                    for headers, block in records(gzip.GzipFile(fileobj=stream) if zipped else stream):
                        kind, payload = headers["warc-type"], None
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        length = int(headers["x-payload-length"]) if "x-payload-length" in headers else None
                        if kind != "revisit":
                            is_http = headers.get("content-type", "").startswith("application/http")
                            payload = block.partition(b"\r\n\r\n")[2] if is_http else block
                            own = payload_digest(payload)
                            if digest not in (None, own):
                                raise ValueError(f"{headers['warc-record-id']} in {path}: the payload isn't that of its digest")
                            digest, length = own, len(payload)
                        rows.append((_bare(headers["warc-record-id"]), kind, headers.get("warc-target-uri"), _bare(headers.get("warc-refers-to")), digest, length, payload))
                        held += len(payload or b"")
                        if held >= RANGE_BYTES or len(rows) >= 1000:
                            yield made()
                            rows, held = [], 0
        yield made()

    n = partitions(paths)
    found = paths.select("path").repartition(n, "path").mapInArrow(frugal(locate), "path string, zipped boolean, offset long, size long")
    # ranges of one package go to many tasks
    return found.repartition(n, "path", "offset").mapInArrow(frugal(read), "record_id string, record_type string, target_uri string, refers_to string, digest string, payload_bytes long, payload binary")


def id_of(record: str):
    """The row id in a record id of this writer; null for others."""
    return F.regexp_extract(F.col(record), f"^{RECORD}(-?[0-9]+)$", 1).try_cast("long")
