"""Web archives in ZIP packages: stored members, read by ranges without extraction.

A package holds ``archive/data.warc.gz``, one gzip member a record, and ``indexes/index.cdxj`` with the
place of each record. Members are stored, so a record's bytes are a range of the package.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, new_path
from .common import by_bytes, hot_join

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records after which a task starts a new package.
PACKAGE_BYTES = 64 << 20
#: Neighbouring records up to so many bytes apart in one package are fetched by one read of at most that size.
READ_BYTES = 4 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: object) -> str:
    """The record's name of a page id: null has none, an empty text is a dot, what a header can't hold is quoted."""
    plain = "" if page_id is None else quote(str(page_id), safe="").replace(".", "%2E") or "."
    return f"<urn:page:{plain}>"


def _page_id(name: str | None, number: bool) -> int | str | None:
    plain = (name or "").removeprefix("<urn:page:").removesuffix(">")
    if not plain:
        return None
    return int(plain) if number else "" if plain == "." else unquote(plain)


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, revisit: bool) -> bytes:
    """One WARC record. A revisit has the response's HTTP head, with the full length, and no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers and HTTP headers, names in lower case, and the payload."""

    def fields(lines: bytes) -> dict[str, str]:
        pairs = (line.split(":", 1) for line in lines.decode().split("\r\n")[1:])
        return {k.strip().lower(): v.strip() for k, v in pairs}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


class PackageWriter:
    """Writes one package to any file system that pyarrow opens."""

    def __init__(self, path: str):
        fs, where = pafs.FileSystem.from_uri(path)
        fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
        self.path, self.size, self.index = path, 0, []
        self.out = fs.open_output_stream(where)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, key: str, raw: bytes) -> None:
        packed = gzip.compress(raw, 3, mtime=0)
        self.index.append((key, self.size, len(packed)))
        self.data.write(packed)
        self.size += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        lines = [f"{key} {json.dumps({'offset': at, 'length': n, 'filename': DATA})}\n" for key, at, n in sorted(self.index)]
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(lines))
        self.zip.close()
        self.out.close()
        return self.path, len(self.index)


class Package:
    """Reads members of a ZIP file by ranges: end record, ZIP64 end record, central directory, local headers."""

    def __init__(self, source):
        self.source = source
        size = source.size() if callable(getattr(source, "size", None)) else source.seek(0, io.SEEK_END)
        tail_at = max(0, size - 65_557)
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("not a ZIP file: no end record")
        count, length, at = struct.unpack("<HII", tail[end + 10 : end + 20])
        locator = tail[end - 20 : end] if end >= 20 else b""
        if locator[:4] == b"PK\x06\x07":
            place = int.from_bytes(locator[8:16], "little")
            record64 = self.read(place, 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("broken ZIP64 end record")
            count, length, at = struct.unpack("<QQQ", record64[32:56])
        self.members = dict(self._directory(self.read(at, length), count))

    def read(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    @staticmethod
    def _directory(raw: bytes, count: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        """(name, (method, stored size, local header's place))."""
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack("<HH", raw[at + 8 : at + 12])
            packed, plain, n, extra, comment = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
            local = int.from_bytes(raw[at + 42 : at + 46], "little")
            name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            field, stop = at + 46 + n, at + 46 + n + extra
            while field + 4 <= stop:
                kind, length = struct.unpack("<HH", raw[field : field + 4])
                if kind == 1:  # sizes that don't fit 32 bits, in this order
                    wide = iter(struct.unpack(f"<{length // 8}Q", raw[field + 4 : field + 4 + length // 8 * 8]))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    local = next(wide) if local == 0xFFFFFFFF else local
                field += 4 + length
            yield name, (method, packed, local)
            at = stop + comment

    def locate(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member begin, and how many there are."""
        method, size, local = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        head = self.read(local, 30)
        n, extra = struct.unpack("<HH", head[26:30])
        return local + 30 + n + extra, size

    def index(self) -> list[tuple[str, str, int, int]]:
        """(key, member, offset, length) of all records of all indexes."""
        out = []
        for name in self.members:
            if name.startswith("indexes/") and name.endswith(".cdxj"):
                for line in self.read(*self.locate(name)).decode().splitlines():
                    key, _, about = line.partition(" ")
                    about = json.loads(about)
                    out.append((key, about["filename"], about["offset"], about["length"]))
        return out

    def records(self) -> Iterator[tuple[str, bytes]]:
        """Every indexed record; neighbours share a read."""
        places = sorted((member, offset, length, key) for key, member, offset, length in self.index())
        starts = {member: self.locate(member)[0] for member in {p[0] for p in places}}
        k = 0
        while k < len(places):
            member, first = places[k][:2]
            last, stop = k, first + places[k][2]
            while last + 1 < len(places) and places[last + 1][0] == member and max(stop, sum(places[last + 1][1:3])) - first <= READ_BYTES:
                last += 1
                stop = max(stop, sum(places[last][1:3]))
            raw = self.read(starts[member] + first, stop - first)
            for _, offset, length, key in places[k : last + 1]:
                yield key, gzip.decompress(raw[offset - first : offset - first + length])
            k = last + 1


def assign_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to, revisit: which pages repeat the payload of one with a smaller id.

    Pages whose payload has ``min_bytes`` or more share a response: the smallest page_id's (rows that
    equal it in id and payload are responses too). Null ids come last, null html is an empty payload.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha1(body.cast("binary")).alias("sha1"))
    shared = pages.select("page_id", F.sha1(body.cast("binary")).alias("sha1"), F.octet_length(body).alias("size"))
    shared = shared.filter(F.col("size") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    shared = shared.filter("copies > 1").checkpoint()
    joined = hot_join(rows, shared, "sha1", "copies", pages.count())
    revisit = F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_packages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the table of packages: path, records.

    Each attempt of a task writes files of its own in the shared folder, and only those that a
    finished attempt reports are in the table, so lost executors leave no half package in it.
    """
    folder = new_path(pages.sparkSession, "packages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in by_bytes(batches, "html"):
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                writer = writer or PackageWriter(f"{folder}/{uuid.uuid4().hex}.zip")
                payload = html.encode("utf-8", "surrogatepass")
                writer.add(_name(page_id), record(page_id, url, payload, payload_digest(payload), refers_to, revisit))
                if writer.size >= PACKAGE_BYTES:
                    done, writer = [*done, writer.close()], None
        done += [writer.close()] if writer else []
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    written = assign_records(pages, min_bytes).mapInArrow(run, "path string, records bigint")
    return materialise(written, "package-list")


def read_packages(packages: DataFrame, payloads: bool = False, ids: str = "bigint") -> DataFrame:
    """One row per record of the packages at ``path``: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    With ``payloads`` also payload, null for revisits. ``ids`` is the type of page ids, bigint or string. A response whose
    payload differs from its digest is an error.
    """
    if ids not in ("bigint", "string"):
        raise ValueError("page ids are bigint or string")
    number, id_kind = ids == "bigint", pa.int64() if ids == "bigint" else pa.string()
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    kinds = [id_kind, pa.string(), pa.int64(), pa.string(), pa.string(), id_kind, *[pa.binary()] * payloads]

    def row(raw: bytes) -> tuple:
        warc, http, payload = parse_record(raw)
        kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and payload_digest(payload) != digest:
            raise ValueError(f"record {warc['warc-record-id']} does not match its digest")
        out = (_page_id(warc["warc-record-id"], number), warc.get("warc-target-uri"), int(http["content-length"]), digest, kind, _page_id(warc.get("warc-refers-to"), number))
        return (*out, payload if kind == "response" else None) if payloads else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, where = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(where) as source:
                    held, size = [], 0
                    for _, raw in Package(source).records():
                        held.append(row(raw))
                        size += len(raw) if payloads else 200
                        if size >= READ_BYTES:
                            yield _batch(held, names, kinds)
                            held, size = [], 0
                    yield _batch(held, names, kinds)

    schema = f"page_id {ids}, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to {ids}" + ", payload binary" * payloads
    spread = packages.select("path").repartition(max(1, packages.count()), "path")
    return spread.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def find_packages(spark: SparkSession, folder: str) -> DataFrame:
    """The packages of a folder that the session can read, as a table of paths."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path")
