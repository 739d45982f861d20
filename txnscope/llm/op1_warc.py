"""WARC archives as a Spark data source (``format("warc")``).

Files are ``.warc.gz`` with one gzip member per record. A member carries its
own compressed and full length in the gzip extra field ``sl`` (the skip
lengths of the WARC format's gzip annex), so a reader can pass over it
without inflating the body. Plain ``.warc`` files and gzip members without
``sl`` are read as well.

Reading: partitions are sets of files packed to about ``partitionBytes``;
filters on record headers are pushed into the reader; each record's headers
are parsed first, and the body is inflated only if the record passes and the
requested schema has ``payload`` (give ``.schema(...)`` with the wanted
columns). One record is in memory at a time.

Writing: each task writes files of its own attempt, rolled at
``fileBytes``; the commit lists the files of the successful attempts in a
manifest of the job's own (``_manifest-*.json``), and the files of all
manifests are what readers look at: a second write adds to the first, and one
in mode ``overwrite`` replaces it. Files that no manifest lists (a lost
executor's, a failed attempt's) are never read; if the job fails, those of its
finished tasks are removed.

Paths may be on any filesystem that pyarrow opens (local or mounted folders,
hdfs, s3, gs).
"""

from __future__ import annotations

import io
import json
import posixpath
import struct
import uuid
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
    WriterCommitMessage,
)

from txnscope.llm.common import shared_path

SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, content_type string, "
          "content_length long, payload_digest string, refers_to string, http_length long, "
          "headers map<string,string>, payload binary")
# Header names of the format.
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
             "warc_date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest",
             "refers_to": "warc-refers-to"}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAX_HEADER = 1 << 20
CHUNK = 1 << 16


def open_fs(path: str):
    """(filesystem, path inside it) of a URI or a plain path."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


# ---------------------------------------------------------------- records

def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member whose extra field holds its own lengths."""
    c = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = c.compress(data) + c.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
            + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def one_line(value) -> str:
    """A header value: control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in str(value))


def parse_head(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in head.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:  # folded value
            out[last] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            k, _, v = line.partition(b":")
            last = k.strip().lower().decode("ascii", "replace")
            out[last] = v.strip().decode("utf-8", "replace")
    return out


class _Inflating:
    """Reads the plain bytes of the gzip member that starts at the current
    place of ``f``; ``finish`` leaves ``f`` behind the member."""

    def __init__(self, f):
        self.f, self.start, self.size = f, f.tell(), 0
        head = f.read(10)
        flags = head[3]
        if flags & 4:
            extra = f.read(struct.unpack("<H", f.read(2))[0])
            at = 0
            while at + 4 <= len(extra):
                tag, n = struct.unpack_from("<2sH", extra, at)
                if tag == b"sl" and n == 8:
                    self.size = struct.unpack_from("<I", extra, at + 4)[0]
                at += 4 + n
        for bit in (8, 16):  # name, comment
            if flags & bit:
                while f.read(1) not in (b"\0", b""):
                    pass
        if flags & 2:
            f.read(2)
        self.z = zlib.decompressobj(-zlib.MAX_WBITS)
        self.data = f.tell()
        self.used = 0

    def read(self, n: int) -> bytes:
        out = []
        while n > 0 and not self.z.eof:
            src = self.z.unconsumed_tail
            if not src:
                src = self.f.read(min(CHUNK, max(512, n)))
                self.used += len(src)
                if not src:
                    raise EOFError("the file ends inside a record")
            got = self.z.decompress(src, n)
            out.append(got)
            n -= len(got)
        return b"".join(out)

    def finish(self):
        if self.size:
            self.f.seek(self.start + self.size)
            return
        while not self.z.eof:
            self.read(CHUNK)
        self.f.seek(self.data + self.used - len(self.z.unused_data) + 8)


class _Plain:
    def __init__(self, f):
        self.f, self.start, self.size = f, f.tell(), 0
        self.read = f.read

    def finish(self):
        self.f.seek(self.start + self.size)


def read_records(f, wanted, with_body: bool):
    """Yield (headers, body or None) of the records for which
    ``wanted(headers)`` holds. A body that isn't asked for stays deflated."""
    while True:
        at = f.tell()
        two = f.read(2)
        if not two:
            return
        if two in (b"\r\n", b"\n\r"):  # padding between records
            continue
        f.seek(at)
        src = _Inflating(f) if two == b"\x1f\x8b" else _Plain(f)
        buf = b""
        while (end := buf.find(b"\r\n\r\n")) < 0:
            more = src.read(1024)
            if not more or len(buf) > MAX_HEADER:
                raise ValueError(f"no record header at byte {at}")
            buf += more
        if not buf.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = parse_head(buf[:end])
        length = int(headers.get("content-length", 0))
        if isinstance(src, _Plain):
            src.size = end + 4 + length + 4
        if wanted(headers):
            if with_body:
                rest = buf[end + 4:]
                if len(rest) < length:
                    rest += src.read(length - len(rest))
                yield headers, rest[:length]
            else:
                # enough of the block for its own (HTTP) headers
                rest = buf[end + 4:]
                if "application/http" in headers.get("content-type", ""):
                    while b"\r\n\r\n" not in rest and len(rest) < length:
                        more = src.read(min(1024, length - len(rest)))
                        if not more:
                            break
                        rest += more
                yield headers, rest[:length]
        src.finish()


def http_parts(headers: dict, block: bytes) -> tuple[dict, bytes]:
    """(HTTP headers, payload) of a block; other content is all payload."""
    if "application/http" in headers.get("content-type", ""):
        head, sep, payload = block.partition(b"\r\n\r\n")
        if sep:
            return parse_head(head), payload
    return {}, block


# ---------------------------------------------------------------- filters

def header_value(headers: dict, column: str):
    if column == "content_length":
        return int(headers["content-length"]) if "content-length" in headers else None
    return headers.get(HEADER_OF[column])


TESTS = {
    EqualTo: lambda v, x: v is not None and x is not None and v == x,
    In: lambda v, x: v is not None and v in x,
    GreaterThan: lambda v, x: v is not None and v > x, GreaterThanOrEqual: lambda v, x: v is not None and v >= x,
    LessThan: lambda v, x: v is not None and v < x, LessThanOrEqual: lambda v, x: v is not None and v <= x,
    StringStartsWith: lambda v, x: v is not None and v.startswith(x),
    StringEndsWith: lambda v, x: v is not None and v.endswith(x),
    StringContains: lambda v, x: v is not None and x in v,
    IsNull: lambda v, x: v is None, IsNotNull: lambda v, x: v is not None,
}


def header_test(flt):
    """(column, kind, value, negated) of a filter on a header, else None."""
    negated = isinstance(flt, Not)
    inner = flt.child if negated else flt
    if type(inner) not in TESTS or len(inner.attribute) != 1:
        return None
    column = inner.attribute[0]
    if column not in HEADER_OF and column != "content_length":
        return None
    return column, type(inner), getattr(inner, "value", None), negated


def passes(headers: dict, tests: list) -> bool:
    for column, kind, value, negated in tests:
        v = header_value(headers, column)
        if negated and v is None and kind not in (IsNull, IsNotNull):
            return False  # NOT of an unknown is unknown
        if TESTS[kind](v, value) == negated:
            return False
    return True


# ---------------------------------------------------------------- source

@dataclass
class WarcFiles(InputPartition):
    paths: list[str] = field(default_factory=list)

    def __init__(self, paths):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        known = {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown := [c for c in self.columns if c not in known]:
            raise ValueError(f"unknown columns {unknown}")
        self.options = dict(options)
        self.tests: list = []

    def pushFilters(self, filters):
        for flt in filters:
            test = header_test(flt)
            if test is None:
                yield flt
            else:
                self.tests.append(test)

    def partitions(self):
        """Files, largest first, packed into sets of about partitionBytes."""
        fs, root = open_fs(self.options["path"])
        target = int(self.options.get("partitionBytes", 32 << 20))
        sized = listing(fs, root)
        sets: list[list[str]] = []
        room = 0
        for path, size in sorted(sized, key=lambda x: (-x[1], x[0])):
            if not sets or size > room:
                sets.append([])
                room = target
            sets[-1].append(path)
            room -= size
        return [WarcFiles(s) for s in sets or [[]]]

    def read(self, partition):
        fs, _ = open_fs(self.options["path"])
        body = "payload" in self.columns
        for path in partition.paths:
            with fs.open_input_file(path) as raw, io.BufferedReader(raw, CHUNK) as f:
                for headers, block in read_records(f, lambda h: passes(h, self.tests), body):
                    yield tuple(self.row(headers, block))

    def row(self, headers, block):
        http, payload = http_parts(headers, block)
        for c in self.columns:
            if c == "payload":
                yield payload
            elif c == "headers":
                yield headers
            elif c == "http_length":
                n = http.get("content-length", "")
                yield int(n) if n.isdigit() else None
            else:
                yield header_value(headers, c)


def manifests(fs, root: str) -> list[str]:
    names = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(i.path for i in names if posixpath.basename(i.path).startswith("_manifest") and i.path.endswith(".json"))


def listing(fs, root: str) -> list[tuple[str, int]]:
    """The files of the manifests if there are any, else all .warc[.gz] files."""
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(root, info.size)]
    known = manifests(fs, root)
    if known:
        out = []
        for path in known:
            with fs.open_input_file(path) as f:
                out += [(posixpath.join(root, n), s) for n, s in json.loads(f.read())]
        return out
    return [(i.path, i.size) for i in fs.get_file_info(pafs.FileSelector(root, recursive=True))
            if i.type == pafs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]


@dataclass
class WarcWritten(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_id, record_type, target_uri, warc_date, content_type,
    payload_digest, refers_to, payload (binary), payload_length. Types response and revisit get an HTTP
    block; a revisit keeps the HTTP headers (with the payload's length) and no payload."""

    def __init__(self, options, overwrite: bool = False):
        self.options, self.overwrite = dict(options), overwrite

    def write(self, iterator):
        fs, root = open_fs(self.options["path"])
        roll, level = int(self.options.get("fileBytes", 16 << 20)), int(self.options.get("level", 3))
        fs.create_dir(root, recursive=True)
        files, out, size, name = [], None, 0, ""
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"  # one task attempt's own
                    out, size = fs.open_output_stream(posixpath.join(root, name), compression=None), 0
                member = gzip_member(self.record(row), level)
                out.write(member)
                size += len(member)
                if size >= roll:
                    out.close()
                    files.append([name, size])
                    out = None
        if out is not None:
            out.close()
            files.append([name, size])
        return WarcWritten(files)

    @staticmethod
    def record(row: dict) -> bytes:
        payload = row.get("payload") or b""
        kind = row["record_type"]
        n = row.get("payload_length")
        n = len(payload) if n is None else n
        headers = [("WARC-Type", kind), ("WARC-Record-ID", one_line(row["record_id"])),
                   ("WARC-Date", row.get("warc_date") or "1970-01-01T00:00:00Z")]
        if row.get("target_uri") is not None:
            headers.append(("WARC-Target-URI", one_line(row["target_uri"])))
        if row.get("payload_digest"):
            headers.append(("WARC-Payload-Digest", one_line(row["payload_digest"])))
        if kind not in ("response", "revisit"):
            return record_bytes([*headers, ("Content-Type", row.get("content_type") or "application/octet-stream")], payload)
        headers.append(("Content-Type", "application/http; msgtype=response"))
        http = f"HTTP/1.1 200 OK\r\nContent-Type: {one_line(row.get('content_type') or 'text/html; charset=utf-8')}\r\nContent-Length: {n}\r\n\r\n"
        if kind == "revisit":
            headers += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", one_line(row["refers_to"]))]
            payload = b""
        return record_bytes(headers, http.encode() + payload)

    def commit(self, messages):
        fs, root = open_fs(self.options["path"])
        fs.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        before = [p for p in manifests(fs, root)] if self.overwrite else []
        old = [p for p, _ in listing(fs, root)] if before else []
        with fs.open_output_stream(posixpath.join(root, f"_manifest-{uuid.uuid4().hex}.json"), compression=None) as out:
            out.write(json.dumps(files).encode())
        for path in [*before, *old]:  # the lists first: what they named is then no longer read
            fs.delete_file(path)

    def abort(self, messages):
        fs, root = open_fs(self.options["path"])
        for m in messages:
            for name, _ in m.files if m is not None else ():
                fs.delete_file(posixpath.join(root, name))


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---------------------------------------------------------------- pages

MIN_SHARED = 100
URN = "urn:page:"


def page_records(pages: DataFrame, min_bytes: int = MIN_SHARED) -> DataFrame:
    """One record per row of ``pages`` (page_id, url, html).

    Of the rows with equal payloads of at least ``min_bytes``, those with the
    smallest page_id are responses (rows that repeat it are responses too)
    and the others revisit it; a null page_id counts as larger than any. A
    null html has an empty payload. Only payloads that occur more than once
    enter the join, whose large side Spark may split when one payload holds
    many rows.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    shared = (rows.filter(F.length("payload") >= min_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1 and first_id is not null").select("digest", "first_id"))
    rows = rows.join(shared, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    page_urn = F.concat(F.lit(f"<{URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))
    return rows.select(
        page_urn.alias("record_id"), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.col("url").alias("target_uri"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"<{URN}"), F.col("first_id").cast("string"), F.lit(">"))).alias("refers_to"),
        F.length("payload").cast("long").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def write_archive(records: DataFrame, path: str, mode: str = "append", **options) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode(mode).options(path=path, **options).save()


def read_archive(spark: SparkSession, path: str, columns: str = SCHEMA, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).options(path=path, **options).load()


def page_index(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type,
    refers_to. A response's size and digest come from the payload read; a
    revisit's from its headers."""
    page = lambda c: F.regexp_extract(c, rf"^<{URN}(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    response = F.col("record_type") == "response"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"))


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archive(page_records(pages), path)
    return page_index(read_archive(
        spark, path, "record_id string, record_type string, payload_digest string, refers_to string, http_length long, payload binary"))
