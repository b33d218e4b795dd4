"""Log files as a data source of Spark: ``spark.read.format("tallylog")`` and ``readStream``, once ``register`` was called.

Rows are those of ``read_lines``: value, file, block, pos. A block is a range of bytes; a line belongs to the
block in which it begins. A partition is a block, or small ones that follow each other. Lines end at line feeds; carriage returns before them
go, bad UTF-8 becomes U+FFFD.

Options: ``path`` (a file, a folder or a pattern of file names; hidden files don't count), ``blockBytes``,
``from`` (JSON: the byte of each file to begin at, which follows a line feed) and ``unfinished`` (``keep``
or ``wait``): whether a last line without a line feed is read.

A stream's offset is the number of bytes of each file that have been read. It takes whole lines only, so a
line that is still being written comes with a later batch.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .scratch import opened

#: Bytes read at once, and of a block unless an option says otherwise; bytes up to which small blocks share a partition.
PIECE, BLOCK, TASK = 4 << 20, 64 << 20, 8 << 20
SCHEMA = "value string, file string, block long, pos long"
COLUMNS = pa.schema([("value", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("pos", pa.int64())])


class Range(InputPartition):
    """The lines that begin in a range of bytes; ``end`` is where the file's lines end."""

    def __init__(self, file: str, start: int, stop: int, end: int):
        self.file, self.start, self.stop, self.end = file, start, stop, end


class Ranges(InputPartition):
    """Ranges that are read one after the other."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def files_at(path: str) -> dict[str, int]:
    """Sizes of the files at ``path``, by URI, in order of their names."""
    from pyarrow import fs

    folder, _, name = path.rstrip("/").rpartition("/")
    if any(c in name for c in "*?["):
        disk, local = opened(folder or "/")
        found = [f for f in disk.get_file_info(fs.FileSelector(local)) if fnmatch.fnmatchcase(f.base_name, name)]
    else:
        disk, local = opened(path)
        own = disk.get_file_info(local)
        if own.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [own] if own.is_file else disk.get_file_info(fs.FileSelector(local))
    prefix = path[: path.index("://") + 3] if "://" in path else "file://"
    return {prefix + f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.is_file and f.size and f.base_name[0] not in "._"}


def whole_lines(file: str, start: int, size: int) -> int:
    """Where the last line with a line feed ends, ``start`` if there is none from there on."""
    disk, local = opened(file)
    with disk.open_input_file(local) as source:
        stop = size
        while stop > start:
            begin = max(start, stop - PIECE)
            source.seek(begin)
            at = source.read(stop - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            stop = begin
    return start


def ranges(file: str, start: int, end: int, each: int) -> list[Range]:
    return [Range(file, at, min(at + each, end), end) for at in range(start, end, each)]


def dealt(parts: list[Range]) -> list[Ranges]:
    """Partitions of ranges in their order: as many small ranges together as make TASK bytes, so that there are no more tasks than the bytes ask for."""
    out, size = [], TASK
    for part in parts:
        own = part.stop - part.start
        if size + own > TASK:
            out.append(Ranges([]))
            size = 0
        out[-1].ranges.append(part)
        size += own
    return out


def lines_of(part: Range) -> Iterator[pa.RecordBatch]:
    disk, local = opened(part.file)
    with disk.open_input_file(local) as source:
        at = max(part.start - 1, 0)  # a line feed before the range says that a line begins with it
        source.seek(at)
        held, count, skip = b"", 0, part.start > 0
        while True:
            wanted = max(part.stop - at - len(held), len(held), 4096)  # no more than the range, then as much again for its last line
            piece = source.read(min(PIECE, wanted, part.end - at - len(held)))
            held += piece
            if skip:
                first = held.find(b"\n")
                if first >= 0:
                    at, held, skip = at + first + 1, held[first + 1 :], False
                elif piece:
                    at, held = at + len(held), b""
                    continue
                else:
                    return
            if at >= part.stop:
                return
            last = not piece or at + len(held) >= part.end
            stop = len(held) if last else held.rfind(b"\n") + 1
            if stop:
                values = split(held[:stop], part.stop - at)
                if len(values):
                    yield pa.RecordBatch.from_arrays([values, pa.repeat(part.file, len(values)), pa.repeat(part.start, len(values)), pa.array(np.arange(count, count + len(values)))], schema=COLUMNS)
                count, at, held = count + len(values), at + stop, held[stop:]
            if last:
                return


def split(text: bytes, before: int) -> pa.Array:
    """The lines of ``text`` that begin before its byte ``before``."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    if not len(ends) or ends[-1] < len(text):
        ends = np.append(ends, len(text))
    starts = np.concatenate(([0], ends[:-1]))
    n = int(np.searchsorted(starts, before))
    offsets = np.append(starts[:n], ends[n - 1]).astype(np.int32) if n else np.zeros(1, np.int32)
    try:
        text[: offsets[-1]].decode()
    except UnicodeDecodeError:
        return pa.array([text[a:b].decode(errors="replace").rstrip("\r\n") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
    return pc.utf8_rtrim(pa.StringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text)), "\r\n")


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("blockBytes", BLOCK))
        self.start, self.keep = json.loads(options.get("from", "{}")), options.get("unfinished", "keep") == "keep"

    def partitions(self) -> list[Ranges]:
        out = []
        for file, size in files_at(self.path).items():
            begin = self.start.get(file, 0)
            out += ranges(file, begin, size if self.keep else whole_lines(file, begin, size), self.each)
        return dealt(out)

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        return chain.from_iterable(map(lines_of, partition.ranges)) if partition else iter(())


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("blockBytes", BLOCK))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {file: whole_lines(file, 0, size) for file, size in files_at(self.path).items()}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return dealt([r for file, stop in end.items() for r in ranges(file, start.get(file, 0), stop, self.each)])

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return chain.from_iterable(map(lines_of, partition.ranges))


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tallylog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LogSource)
    return spark
