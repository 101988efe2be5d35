"""Code-intelligence index files as a format to read and write: ``spark.read.format("code_index").load(path)``.

A file is a run of length-delimited messages.  It has no marks to start from in the middle, but a message's head tells how
long it is: a task that owns a range of bytes hops from head to head up to its range, reading no bodies, and decodes the
documents that start inside.  So one large file is many tasks, and the driver only lists names and sizes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .scip import OCCURRENCES, occurrences

RANGE = 64 * 1024 * 1024
FILE = 16 * 1024 * 1024
BATCH = 10_000
DOCUMENT = 2  # the field number of a document
WRITTEN = "relative_path string, occurrences array<struct<symbol:string,line:int,end_line:int,definition:boolean>>"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def heads(f: pa.NativeFile, size: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, field number, first byte of the body, length) of the messages of a file that start before ``end``."""
    at = 0
    while at < min(size, end):
        f.seek(at)
        head = f.read(20)  # two varints of at most ten bytes

        def number(i: int, head: bytes = head, at: int = at) -> tuple[int, int]:
            value = shift = 0
            while i < len(head):
                value |= (head[i] & 0x7F) << shift
                i += 1
                if head[i - 1] < 0x80:
                    return value, i
                shift += 7
            raise ValueError(f"the file ends inside a message that starts at byte {at}")

        key, i = number(0)
        kind = key & 7
        if kind == 2:
            length, i = number(i)
        elif kind == 0:
            length, i = 0, number(i)[1]
        elif kind in (1, 5):
            length = 8 if kind == 1 else 4
        else:
            raise ValueError(f"wire type {kind} at byte {at}")
        if at + i + length > size:
            raise ValueError(f"the file ends inside a message that starts at byte {at}")
        yield at, key >> 3, at + i, length
        at += i + length


class IndexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range = int(options.get("rangebytes", options.get("rangeBytes", RANGE)))

    def partitions(self) -> list[Range]:
        where, path = _place(self.path)
        info = where.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = where.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        files = [x for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
        return [Range(x.path, at, at + self.range) for x in sorted(files, key=lambda x: x.path) for at in range(0, x.size, self.range)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        where, _ = _place(self.path)
        types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
        schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in OCCURRENCES.split(", ")])
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(len(schema))], schema=schema)
            rows.clear()
            return out

        with where.open_input_file(partition.path) as f:
            for start, field, body, length in heads(f, f.size(), partition.end):
                if start < partition.start or field != DOCUMENT:
                    continue
                f.seek(start)
                for row in occurrences(f.read(body - start + length)):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield batch()
        if rows:
            yield batch()


@dataclass
class Done(WriterCommitMessage):
    files: list[tuple[str, str]]  # (temporary, final) names


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes) -> bytes:
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


@lru_cache(1 << 16)
def _occurrence(symbol: str, line: int, end_line: int | None, definition: bool) -> bytes:
    first, last = line - 1, (end_line or line) - 1
    span = (first, 0, last, 0) if last != first else (first, 0, 0)
    return _field(2, _field(1, b"".join(map(_varint, span))) + _field(2, symbol.encode()) + _field(3, int(definition)))


def document(path: str, found: list) -> bytes:
    """A document message of occurrences (symbol, line, end_line, definition), lines from 1."""
    each = [_occurrence(o["symbol"], o["line"], o["end_line"], o["definition"]) for o in found]
    return _field(DOCUMENT, _field(1, path.encode()) + b"".join(each))


def documents(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The document messages of rows (relative_path, occurrences); those without a path are left out."""
    lists = batch.column("occurrences").fill_null([])
    inner = lists.flatten()
    parts = [inner.field(k).to_pylist() for k in ("symbol", "line", "end_line", "definition")]
    valid, at = inner.is_valid().to_pylist(), 0
    for path, n in zip(batch.column("relative_path").to_pylist(), pc.list_value_length(lists).to_pylist()):
        if path is not None:
            each = [_occurrence(parts[0][i], parts[1][i], parts[2][i], parts[3][i]) for i in range(at, at + n) if valid[i]]
            yield _field(DOCUMENT, _field(1, path.encode()) + b"".join(each))
        at += n


class IndexWriter(DataSourceArrowWriter):
    """Files of about ``FILE`` bytes, named with a dot until the job commits: readers never see what a lost or repeated task
    left.  A reader's task hops over the heads before its range, so no file grows with the table."""

    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("index files are only appended")
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        where, path = _place(self.path)
        where.create_dir(path, recursive=True)
        message, out, size = Done([]), None, 0
        try:
            for b in iterator:
                for body in documents(b):
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.scip"
                        message.files.append((f"{path}/.{name}", f"{path}/{name}"))
                        out, size = where.open_output_stream(message.files[-1][0]), 0
                    size += out.write(body)
                    if size >= FILE:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return message

    def commit(self, messages: list) -> None:
        where, _ = _place(self.path)
        for m in messages:
            for temporary, final in m.files if m is not None else ():
                where.move(temporary, final)

    def abort(self, messages: list) -> None:
        where, _ = _place(self.path)
        for m in messages:
            for temporary, _final in m.files if m is not None else ():
                if where.get_file_info(temporary).type == fs.FileType.File:
                    where.delete_file(temporary)


class IndexSource(DataSource):
    """Reads ``relative_path, symbol, line, end_line, definition``; writes ``relative_path, occurrences``.  Option
    ``rangeBytes``: how many bytes of a file a task reads."""

    @classmethod
    def name(cls) -> str:
        return "code_index"

    def schema(self) -> str:
        return OCCURRENCES

    def reader(self, schema) -> IndexReader:
        return IndexReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> IndexWriter:
        return IndexWriter(dict(self.options), overwrite)
