"""Log files that grow, as a stream: every whole line once, wherever the file ended at the last trigger.

A streaming data source whose offset names, for each file of a folder, the byte
behind its last whole line and a checksum of its first line. A trigger looks for the last line end of the
files that have grown and reads only what is new, in ranges of bounded size,
one a task. A line without an end stays for a later trigger. A file that got
shorter or begins with another line was replaced and is read from its start; one that
is gone is forgotten. Files below sub-folders and hidden ones (``_x``, ``.x``) are skipped.

``start``, the byte at which a line begins, numbers the lines of a file in order.
Lines end with a line feed; a carriage return before it is cut off, bad UTF-8 is replaced.
The folder is opened by pyarrow's file systems (local, HDFS, S3, GCS) on the driver and on the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "growing_lines"
RANGE = 64 << 20  # bytes of one file that a task reads
BLOCK, TAIL = 1 << 20, 1 << 16
HEAD = 1 << 12  # bytes of a first line that its checksum is made of


@dataclass
class _Range(InputPartition):
    """Lines of one file that begin at ``begin`` or later and before ``end``; ``first`` is where a line begins for sure."""

    path: str
    first: int
    begin: int
    end: int


def last_line_end(file: pa.NativeFile, begin: int, end: int) -> int:
    """The byte behind the last line feed of a part of a file, or ``begin``."""
    while end > begin:
        at = max(begin, end - TAIL)
        file.seek(at)
        found = file.read(end - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        end = at
    return begin


def first_line(file: pa.NativeFile, end: int) -> int:
    """Checksum of a file's first line, or of as much of it as counts."""
    file.seek(0)
    return zlib.crc32(file.read(min(end, HEAD)).split(b"\n", 1)[0])


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, length: int):
        self.folder, self.length = folder, length
        self.known: dict[str, tuple[int, int, dict]] = {}  # size, time and offset of files as last seen

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        files = [f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.size]
        with ThreadPoolExecutor(16) as pool:
            offsets = list(pool.map(lambda f: self._offset(system, f), files))
        self.known = {f.path: (f.size, f.mtime_ns, o) for f, o in zip(files, offsets)}
        return {f.path: o for f, o in sorted(zip(files, offsets), key=lambda x: x[0].path) if o["end"]}

    def _offset(self, system: fs.FileSystem, info: fs.FileInfo) -> dict:
        size, time, offset = self.known.get(info.path, (0, 0, {"end": 0, "line": 0}))
        if (size, time) == (info.size, info.mtime_ns):
            return offset
        with system.open_input_file(info.path) as file:
            line = first_line(file, info.size)
            begin = offset["end"] if offset["line"] == line and offset["end"] <= info.size else 0
            end = last_line_end(file, begin, info.size)
        return {"end": end, "line": line if end else 0}

    def partitions(self, start: dict, end: dict) -> Sequence[_Range]:
        out = []
        for path, offset in end.items():
            before = start.get(path, {"end": 0, "line": offset["line"]})
            same = before["line"] == offset["line"] and before["end"] <= offset["end"]
            first = before["end"] if same else 0
            for begin in range(first, offset["end"], self.length):
                out.append(_Range(path, first, begin, min(begin + self.length, offset["end"])))
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.folder)
        with system.open_input_file(partition.path) as file:
            yield from read_lines(file, partition)


def read_lines(file: pa.NativeFile, part: _Range) -> Iterator[pa.RecordBatch]:
    """The lines of a range; its last one may end behind it."""
    # a line that begins at the range's first byte has its line feed one byte before
    at = part.begin if part.begin == part.first else part.begin - 1
    file.seek(at)
    skipping, rest = at != part.begin, b""
    while at < part.end:  # here ``at`` is where ``rest`` begins
        block = file.read(BLOCK)
        if not block:
            return
        if skipping:
            found = block.find(b"\n")
            if found < 0:
                at += len(block)
                continue
            at, block, skipping = at + found + 1, block[found + 1 :], False
        lines = (rest + block).split(b"\n")
        rest = lines.pop()
        values, starts = [], []
        for line in lines:
            if at >= part.end:
                break
            starts.append(at)
            values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
            at += len(line) + 1
        if values:
            columns = [pa.array([part.path] * len(values)), pa.array(starts, pa.int64()), pa.array(values, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["file_path", "start", "value"])


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines").option("path", folder)``; option ``range``: bytes a task reads."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file_path string, start long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))


def follow_lines(spark: SparkSession, folder: str, length: int = RANGE) -> DataFrame:
    """The lines of the files in ``folder``, those there and those still to be written: file_path, start, value."""
    spark.dataSource.register(GrowingLines)
    # the file systems want a scheme
    folder = folder if ":/" in folder else f"file://{folder}"
    return spark.readStream.format(NAME).option("path", folder).option("range", length).load()
