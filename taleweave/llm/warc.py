"""WARC archives: a writer with a task-level commit, and a Python data source that reads them.

Each record is a gzip member of its own whose header holds the member's length (the ``sl``
field of the WARC standard). The reader plans a partition per file, reads a member's first
bytes to parse the record's headers, decides on the pushed predicates, and steps over
the member without inflating its payload where the record isn't wanted.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringContains, StringStartsWith

LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(block: bytes) -> bytes:
    """One gzip member with its own and its content's length in the extra field ``sl``."""
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = squeeze.compress(block) + squeeze.flush()
    size = 24 + len(body) + 8
    head = struct.pack("<4BIBBH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, size & 0xFFFFFFFF, len(block) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str, date: str, payload: bytes, digest: str, refers_to: str | None, content_type: str = "text/html; charset=utf-8") -> bytes:
    """The bytes of a response record, or of a revisit record that leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if kind == "revisit" else payload)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri:
        lines.append("WARC-Target-URI: " + "".join(c for c in uri if c not in "\r\n"))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(records: DataFrame, folder: str, date: str | None = None) -> list[str]:
    """``records(record_id, uri, kind, payload, digest, refers_to)`` -> the archives' paths in ``folder``.

    Every task writes a file whose name no other attempt uses and returns it; only files that
    successful attempts returned are in the list, so a lost executor leaves at most a stray
    file that no reader sees. Null uri: no target header. Null payload: empty. ``folder`` is
    a URI that all executors reach. An empty partition writes no file.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, path = _opened(folder)
        target.create_dir(path, recursive=True)
        name, out, n = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for row in batch.to_pylist():
                out = out or target.open_output_stream(f"{path}/{name}", compression=None)
                payload = row["payload"] or b""
                out.write(member(record(row["kind"], row["record_id"], row["uri"] or "", date, payload, row["digest"], row["refers_to"])))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [n]})

    chosen = records.selectExpr("record_id", "uri", "kind", "cast(payload as binary) payload", "digest", "refers_to")
    return [r["file"] for r in chosen.mapInArrow(run, "file string, records long").collect()]


def _headers(block: bytes) -> tuple[dict[str, str], int]:
    """The header fields of a record's first bytes (names in lower case) and where its block begins."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return {}, -1
    fields = {}
    for line in block[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


class _Member:
    """A gzip member at the stream's place: inflates as much as is asked for."""

    def __init__(self, stream, at: int):
        self.stream, self.at = stream, at
        stream.seek(at)
        self.have = stream.read(1 << 12)
        self.size = None
        if len(self.have) >= 24 and self.have[3] & 4 and self.have[12:14] == b"sl":
            self.size = struct.unpack("<I", self.have[16:20])[0]
        self.inflate = zlib.decompressobj(31)
        self.pending = self.have

    def read(self, enough: int | None) -> bytes:
        """At least ``enough`` further bytes, or all that is left."""
        out = []
        got = 0
        while not self.inflate.eof and (enough is None or got < enough):
            part = self.inflate.decompress(self.pending, 0 if enough is None else max(1, enough - got))
            self.pending = self.inflate.unconsumed_tail
            out.append(part)
            got += len(part)
            if not self.pending and not self.inflate.eof:
                self.pending = self.stream.read(1 << 16)
                self.have = b""
                if not self.pending:
                    raise EOFError("an archive ends inside a record")
        return b"".join(out)

    def end(self) -> int:
        if self.size:
            return self.at + self.size
        self.read(None)  # no length in the header: only inflating finds the end
        return self.stream.tell() - len(self.inflate.unused_data)


SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, http_length long, headers map<string,string>, payload binary"
#: Columns that are header fields, and so can be decided on before the payload is decoded.
FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def _value(fields: dict[str, str], column: str) -> str | None:
    value = fields.get(FIELDS[column])
    return value[1:-1] if value and column in ("record_id", "refers_to") and value[:1] == "<" else value


class WarcSource(DataSource):
    """``spark.read.format("warc")`` over archives given by ``load(path, ...)`` or option ``paths`` (one a line).

    Option ``payload=false`` leaves every payload out undecoded.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in (options.get("paths") or options.get("path") or "").split("\n") if p]
        self.payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what compares a header column with constants; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in FIELDS and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.tests.append((column, "in", (f.value,)))
            elif column in FIELDS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in FIELDS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", (f.value,)))
            elif column in FIELDS and isinstance(f, StringContains):
                self.tests.append((column, "contains", (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def _wanted(self, fields: dict[str, str]) -> bool:
        for column, how, values in self.tests:
            value = _value(fields, column)
            if value is None or not (value in values if how == "in" else value.startswith(values[0]) if how == "starts" else values[0] in value):
                return False
        return True

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not self.paths:
            return
        source, path = _opened(partition.path)
        types = [pa.string()] * 6 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = ["record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to", "http_length", "headers", "payload"]
        rows: list[list] = [[] for _ in names]
        held = 0
        with source.open_input_file(path) as stream:
            at, end = 0, stream.size()
            while at < end:
                entry = _Member(stream, at)
                start = entry.read(2048)
                fields, body = _headers(start)
                while body < 0 and not entry.inflate.eof:
                    start += entry.read(1 << 16)
                    fields, body = _headers(start)
                if self._wanted(fields):
                    length = int(fields.get("content-length", 0))
                    block = start[body:]
                    head = block.find(b"\r\n\r\n")
                    http, payload, begin = {}, None, 0
                    if fields.get("content-type", "").startswith("application/http"):
                        if head < 0:
                            block += entry.read(None)
                            head = block.find(b"\r\n\r\n")
                        http, begin = _headers(block)
                    if self.payload and fields.get("warc-type") != "revisit":
                        payload = (block + entry.read(None))[max(begin, 0) : length]
                    values = [_value(fields, n) for n in ("record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to")]
                    values += [int(http["content-length"]) if "content-length" in http else None, list(fields.items()), payload]
                    for column, value in zip(rows, values):
                        column.append(value)
                    held += len(payload or b"") + 1000
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)
                        rows, held = [[] for _ in names], 0
                at = entry.end()
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)


def read_archives(spark: SparkSession, paths: list[str], payload: bool = True) -> DataFrame:
    """The records of the archives. Predicates on header columns are pushed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("paths", "\n".join(paths)).option("payload", str(payload).lower()).load()
