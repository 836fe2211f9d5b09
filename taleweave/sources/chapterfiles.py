"""Chapters as files of JSON lines: a Python data source with byte ranges, error positions and whole commits."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from taleweave.sources.books import decoded

SCHEMA = "book string, number long, title string, content string"
#: The list of a folder's files; what it doesn't name isn't there.
SELECTION = "selection.json"
#: Bytes of a file that one task reads, at most and by default.
RANGE_BYTES = 64 << 20


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class ChapterFiles(DataSource):
    """``format("chapter_files")`` over a folder that it wrote, or that has a ``selection.json`` of its own.

    A line is one chapter; lines are UTF-8 or GB18030. Option ``range_bytes``: how much of a file a task reads.
    A line that isn't such JSON is an error that names its file and byte.
    """

    @classmethod
    def name(cls) -> str:
        return "chapter_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.names)


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        super().__init__(file)
        self.file, self.start, self.end = file, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"].rstrip("/"), int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        files, folder = _folder(self.path)
        with files.open_input_file(f"{folder}/{SELECTION}") as f:
            listed = json.loads(f.read())["files"]
        return [_Range(x["name"], at, at + self.size) for x in listed for at in range(0, x["bytes"], self.size)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        """The lines that start inside the range."""
        if not partition.file:
            return
        files, folder = _folder(self.path)
        self._rest = b""
        with files.open_input_file(f"{folder}/{partition.file}") as stream:
            at = partition.start
            if at:  # a line that starts at the range's first byte is its own
                stream.seek(at - 1)
                at = at - 1 + sum(map(len, self._line(stream)))
            while at < partition.end:
                line = b"".join(self._line(stream))
                if not line:
                    return
                if line.strip():
                    yield self._chapter(line, partition.file, at)
                at += len(line)

    def _line(self, stream) -> list[bytes]:
        """The stream's next line in pieces, its end included; what was read beyond it is kept for the next."""
        own, rest = [], self._rest
        while True:
            cut = rest.find(b"\n") + 1
            if cut:
                self._rest = rest[cut:]
                return [*own, rest[:cut]]
            own.append(rest)
            rest = stream.read(1 << 20)
            if not rest:
                self._rest = b""
                return own

    def _chapter(self, line: bytes, file: str, at: int) -> tuple:
        try:
            found = json.loads(decoded(line))
            number = found.get("number")
            return found.get("book"), None if number is None else int(number), found.get("title"), found.get("content")
        except (ValueError, AttributeError, TypeError) as e:
            raise ValueError(f"{file}, byte {at}: not a chapter: {e}") from e


@dataclass
class _Written(WriterCommitMessage):
    name: str
    bytes: int
    chapters: int


class _Writer(DataSourceWriter):
    """A folder for each write, a file for each attempt at a task; the selection names those that count, and is written last.

    Until then readers see the folder as it was. After a failure the write's folder goes; after a success what
    lost attempts left in it, and what was there before. A folder has one writer at a time.
    """

    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.own = path.rstrip("/"), names, f"write-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        files, folder = _folder(self.path)
        files.create_dir(f"{folder}/{self.own}", recursive=True)
        name, size, n = f"{self.own}/{uuid.uuid4().hex}.jsonl", 0, 0
        with files.open_output_stream(f"{folder}/{name}") as out:
            for row in rows:
                line = json.dumps(dict(zip(self.names, row)), ensure_ascii=False).encode() + b"\n"
                out.write(line)
                size, n = size + len(line), n + 1
        return _Written(name, size, n)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        files, folder = _folder(self.path)
        files.create_dir(folder, recursive=True)
        listed = [vars(m) for m in messages if m is not None]
        with files.open_output_stream(f"{folder}/{SELECTION}.new") as out:
            out.write(json.dumps({"files": listed, "chapters": sum(x["chapters"] for x in listed)}).encode())
        files.move(f"{folder}/{SELECTION}.new", f"{folder}/{SELECTION}")
        kept = {os.path.basename(x["name"]) for x in listed}
        for found in files.get_file_info(fs.FileSelector(folder)):
            if found.type == fs.FileType.Directory and found.base_name.startswith("write-") and found.base_name != self.own:
                files.delete_dir(found.path)
        for found in files.get_file_info(fs.FileSelector(f"{folder}/{self.own}", allow_not_found=True)):
            if found.base_name not in kept:
                files.delete_file(found.path)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        files, folder = _folder(self.path)
        if files.get_file_info(f"{folder}/{self.own}").type == fs.FileType.Directory:
            files.delete_dir(f"{folder}/{self.own}")


def write_chapter_files(chapters: DataFrame, path: str) -> None:
    """``(book, number, content)`` and maybe ``title`` -> the folder's chapters, all of them or none; those before go."""
    chapters.sparkSession.dataSource.register(ChapterFiles)
    columns = [c for c in ("book", "number", "title", "content") if c in chapters.columns]
    missing = {"title"} - set(columns)
    rows = chapters.select(*columns).selectExpr(*columns, *[f"cast(null as string) as {c}" for c in missing]).selectExpr("cast(book as string) as book", "cast(number as long) as number", "title", "content")
    rows.write.format("chapter_files").mode("overwrite").save(path)


def read_chapter_files(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The chapters of a folder -> ``SCHEMA``."""
    spark.dataSource.register(ChapterFiles)
    return spark.read.format("chapter_files").option("range_bytes", str(range_bytes)).load(path)
