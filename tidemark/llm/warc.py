"""WARC archives as a Spark data source (format "warc").

Writing: a record is a gzip member of its own whose extra field `sl` (of the format's skip-length annex) tells
the member's size, so a reader passes over a record without inflating it. Each task writes files of its own
under names that no other attempt uses; the commit puts a manifest in the folder, and readers see only files
it names, so a lost executor leaves nothing half read.

Reading: files are cut into byte ranges, each a Spark partition; a range begins at the first record whose
start lies in it. A record's header is inflated alone. Pushed predicates on record_type and the header columns
decide on it, and only records that pass have their payload inflated, and that only if the option `payload`
isn't "false".

Files of other makers are read too: plain ones, and gzip ones of one or many members. They have no sizes to jump by,
so such a file is one partition, read forward; payloads of records that do not pass are not kept. Their payload is
the block after the HTTP header (of records whose content type is application/http), or the whole block; transfer
and content encodings stay as they are. A file that ends within a record raises ValueError.

Response records hold an HTTP response with the payload; a revisit holds the HTTP header alone, whose
Content-Length tells the full payload's size, and refers to the record with the payload.

Edge cases: a null html is an empty payload; a null url an empty one; control characters in a url are
percent-encoded; headers that a record lacks are null; a payload of any length is read whole; a page without an id, and each row that repeats the id of the first page with a payload, is a
response; an empty table gives an empty archive; other columns are ignored. Folders may be anywhere that
pyarrow's file systems reach (local and shared disks, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from tidemark.llm.common import arrow_map, materialise, prepare

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Fixed values of the formats: gzip member with an extra field, and our extra subfield.
_MEMBER = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x0c\x00sl\x08\x00"
_SIZES = struct.Struct("<II")
MANIFEST = "_manifest.json"


def member(data: bytes, level: int = 4) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = len(_MEMBER) + _SIZES.size + len(body) + 8
    return _MEMBER + _SIZES.pack(size, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(x: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in x or "")


def record(record_id: str, record_type: str, uri: str | None, refers_to: str | None, digest: str, length: int, payload: bytes) -> bytes:
    """One record's bytes, not compressed; the payload of a revisit is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(uri)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32(digest)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _open(self.path)
        files, out, left = [], None, 0
        try:
            for batch in iterator:
                for row in zip(*(batch.column(c).to_pylist() for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_length", "payload"))):
                    if left <= 0:
                        if out:
                            out.close()
                        files.append([f"part-{uuid.uuid4().hex}.warc.gz", 0])
                        out, left = store.open_output_stream(f"{folder}/{files[-1][0]}", compression=None), self.size
                    data = member(record(*row[:6], row[6] or b""))
                    out.write(data)
                    files[-1][1] += len(data)
                    left -= len(data)
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        store, folder = _open(self.path)
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list) -> None:
        store, folder = _open(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                store.delete_file(f"{folder}/{name}")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, split: int):
        self.path, self.payload, self.split = path, payload, split
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest") and isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)):
                self.tests.append((name, type(f).__name__, set(f.value) if isinstance(f, In) else getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        store, folder = _open(self.path)
        if store.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
                files = json.loads(f.read())
        else:
            files = [[i.base_name, i.size] for i in store.get_file_info(fs.FileSelector(folder)) if i.base_name.endswith((".warc.gz", ".warc"))]
        return [Range(f"{folder}/{name}", a, min(a + self.split, size)) for name, size in files for a in range(0, size, self.split)] or [Range("", 0, 0)]

    def _passes(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            own = row[name]
            if own is None or not (kind == "IsNotNull" or (own == value if kind == "EqualTo" else own in value if kind == "In" else own.startswith(value))):
                return False
        return True

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(k, pa.string())) for n, k in (c.split() for c in SCHEMA.split(", "))])
        rows, held = [], 0
        if partition.file:
            store, _ = _open(self.path)
            with store.open_input_file(partition.file) as f:
                for row in read_any(f, partition.start, partition.end, self._passes, self.payload):
                    rows.append(row)
                    held += 200 + len(row["payload"] or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


def _first_member(f, start: int, end: int) -> int | None:
    """Where the first member from start on begins, if before end."""
    at, tail = start, b""
    while at - len(tail) < end:
        f.seek(at)
        data = f.read(1 << 20)
        if not data:
            return None
        spot = (tail + data).find(_MEMBER)
        if spot >= 0:
            found = at - len(tail) + spot
            return found if found < end else None
        tail = (tail + data)[-len(_MEMBER) + 1 :]
        at += len(data)
    return None


def _headers(warc: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in warc.decode("utf-8", "replace").split("\r\n")[1:])}


def _http_length(http: bytes) -> int | None:
    """What an HTTP header says of its body's length."""
    told = (x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return next((int(x) for x in told if x.isdigit()), None)


def _row(head: dict[str, str], length: int | None) -> dict:
    def bare(name: str) -> str | None:
        return head[name].strip("<>") if head.get(name) else None

    digest = head.get("warc-payload-digest")
    return {
        "record_id": bare("warc-record-id"),
        "record_type": head.get("warc-type"),
        "target_uri": bare("warc-target-uri") if head.get("warc-target-uri", "").startswith("<") else head.get("warc-target-uri"),
        "refers_to": bare("warc-refers-to"),
        "payload_digest": digest and digest.removeprefix("sha1:"),
        "payload_length": length,
        "payload": None,
    }


class Forward:
    """Bytes of a plain or gzip file, from its begin to its end."""

    def __init__(self, f, packed: bool):
        f.seek(0)
        self.f, self.packed, self.held, self.over = f, packed, b"", False
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        raw = self.inflate.unconsumed_tail or self.inflate.unused_data if self.packed else b""
        raw = raw or self.f.read(1 << 20)
        if not raw:
            if self.packed and not self.over:
                raise ValueError("the file ends within a gzip member")
            return False
        if not self.packed:
            self.held += raw
            return True
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.held += self.inflate.decompress(raw, 4 << 20)
        self.over = self.inflate.eof
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the mark, which is passed over; None at the end of the file."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self._more():
                if self.held.strip():
                    raise ValueError("the file ends within a record's header")
                return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int, keep: bool = True) -> bytes:
        """The next n bytes, or nothing if they are only to be passed over."""
        parts = []
        while n:
            if not self.held and not self._more():
                raise ValueError("the file ends within a record")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)


def read_forward(f, packed: bool, passes=lambda row: True, payload: bool = True) -> Iterator[dict]:
    """All records of a file by any maker whose header passes."""
    source = Forward(f, packed)
    while (warc := source.until(b"\r\n\r\n")) is not None:
        warc = warc.lstrip(b"\r\n")
        if not warc.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = _headers(warc)
        left = int(head.get("content-length", 0))
        http, length = b"", left
        if head.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
            while left and b"\r\n\r\n" not in http:
                part = source.take(min(left, 4096))
                http, left = http + part, left - len(part)
            http, _, rest = http.partition(b"\r\n\r\n")
            length = len(rest) + left
        else:
            rest = b""
        told = _http_length(http)
        row = _row(head, told if head.get("warc-type") == "revisit" and told is not None else length)
        keep = passes(row)
        body = source.take(left, keep and payload)
        if keep:
            if payload and head.get("warc-type") != "revisit":
                row["payload"] = rest + body
            yield row
        source.take(4, False)  # the blank lines after a record


def read_any(f, start: int, end: int, passes=lambda row: True, payload: bool = True) -> Iterator[dict]:
    """Records that start in [start, end) of a file written here; all of another file where start is 0."""
    f.seek(0)
    first = f.read(len(_MEMBER))
    if first == _MEMBER:
        yield from read_records(f, start, end, passes, payload)
    elif not start and first:
        yield from read_forward(f, first[:2] == b"\x1f\x8b", passes, payload)


def read_records(f, start: int, end: int, passes=lambda row: True, payload: bool = True) -> Iterator[dict]:
    """Records that start in [start, end) of an open file and whose header passes."""
    at = _first_member(f, start, end) if start else 0
    lead = len(_MEMBER) + _SIZES.size
    while at is not None and at < end:
        f.seek(at)
        first = f.read(4096)
        if first[: len(_MEMBER)] != _MEMBER:
            raise ValueError(f"no record at byte {at}")
        size, full = _SIZES.unpack_from(first, len(_MEMBER))
        inflate = zlib.decompressobj(-15)
        text, rest = inflate.decompress(first[lead:], 2048), b""
        while text.count(b"\r\n\r\n") < 2 and len(text) < full:  # the headers may be long
            source = inflate.unconsumed_tail or f.read(4096)
            if not source:
                raise ValueError(f"the file ends within the record at byte {at}")
            text += inflate.decompress(source, 2048)
        warc, _, rest = text.partition(b"\r\n\r\n")
        head = _headers(warc)
        http, _, _ = rest.partition(b"\r\n\r\n")
        row = _row(head, _http_length(http))
        if passes(row):
            if payload and row["record_type"] == "response":
                f.seek(at + lead)
                packed = f.read(size - lead)
                if len(packed) < size - lead:
                    raise ValueError(f"the file ends within the record at byte {at}")
                data = zlib.decompress(packed, -15)
                row["payload"] = data[len(warc) + 4 + len(http) + 4 : len(data) - 4]
            yield row
        at += size


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") != "false", int(self.options.get("splitbytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("filebytes", 256 << 20)))


def register(spark: SparkSession) -> None:
    """Make format "warc" known to the session, with predicate push-down for Python sources."""
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Records of (page_id, url, html): of payloads of at least `least` bytes only the first page's is kept."""
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "size": F.length("payload").cast("long")})
    told = rows.where(F.col("page_id").isNotNull() & (F.col("size") >= least)).select("page_id", "sha", "size")
    first = told.groupBy("sha", "size").agg(F.min("page_id").alias("first"))
    # pages travel by their own id, so a payload that many share does not gather them
    again = told.join(first, ["sha", "size"]).where("page_id <> first").select("page_id", "sha", "first").distinct()
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    both = rows.join(again, ["page_id", "sha"], "left")
    revisit = F.col("first").isNotNull()
    return both.select(
        name(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, name(F.col("first"))).alias("refers_to"),
        F.col("sha").alias("payload_digest"),
        F.col("size").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def base32(sha: str) -> str:
    return base64.b32encode(bytes.fromhex(sha)).decode()


def write_pages(pages: DataFrame, path: str, least: int = 0, file_bytes: int = 256 << 20) -> None:
    """Write a record for each page."""
    spark = pages.sparkSession
    register(spark)
    store, folder = _open(path)
    store.create_dir(folder)
    page_records(pages, least).write.format("warc").mode("append").option("filebytes", file_bytes).save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True, split_bytes: int = 64 << 20) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("splitbytes", split_bytes).load(path)


def page_digests(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records of pages."""
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS bigint)")
    return records.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """page_digests with length and digest of the payloads as read back; a revisit has those of the record it refers to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = [x.as_py() or b"" for x in b.column(1)]
            digests = [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in payloads]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, payloads)), pa.int64()), pa.array(digests, pa.string())], ["record_id", "payload_length", "payload_digest"])

    full = read_warc(spark, path).where("record_type = 'response'").select("record_id", "payload")
    read, _ = materialise(arrow_map(full, run, "record_id string, payload_length long, payload_digest string"), "digests")
    again = read_warc(spark, path, payload=False).where("record_type = 'revisit'").select("record_id", "refers_to", F.col("payload_digest").alias("told"))
    # an id may stand on several responses; the digest tells which of them is meant
    held = read.distinct().select(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("told"), "payload_length", "payload_digest")
    revisits = again.join(held, ["refers_to", "told"], "left").select("record_id", "payload_length", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    responses = read.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    return page_digests(responses.unionByName(revisits))
