"""A streaming source of files that grow: every line once, by byte offsets for each file.

Spark's own file sources read a file once and whole. Here the offset of a stream is the number of bytes read of each
file, up to its last complete line, and lives in the stream's checkpoint; a batch is the ranges between
two offsets. Ranges are cut into partitions of about `split_bytes`: a line belongs to the partition that its
first byte lies in, so partitions need not begin at lines. A restart goes on at the stored offsets.

Defined cases: a line without its line feed waits for it; a file that became shorter was replaced, and is read anew;
a file that is gone leaves the offsets; empty files have no lines; bytes that are no UTF-8 become replacement
characters; names that begin with a dot or an underscore are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, chunk long, line_no long, line string, modified timestamp"
SPLIT_BYTES, BLOCK = 64 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    file: str
    first: int  # where the batch begins in the file
    start: int
    end: int
    modified: float


class GrowingFiles(DataSource):
    """`spark.readStream.format("growing_files").load(path)`."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return Reader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


class Reader(DataSourceStreamReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def _files(self) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
        fs, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        return fs, [f for f in found if f.is_file and not f.base_name.startswith((".", "_"))]

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        """{file: [bytes up to the last line feed, modification time]}, as one JSON text."""
        fs, files = self._files()
        ends = {f.path: [_complete(fs, f), f.mtime.timestamp() if f.mtime else 0.0] for f in files if f.size}
        return {"files": json.dumps(dict(sorted(ends.items())))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for file, (size, modified) in now.items():
            first = before.get(file, [0])[0]
            first = first if first <= size else 0
            for at in range(first, size, self.split_bytes):
                out.append(Range(file, first, at, min(at + self.split_bytes, size), modified))
        # a batch has a partition, if only an empty one
        return out or [Range("", 0, 0, 0, 0.0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        from datetime import datetime, timezone

        if partition.start >= partition.end:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), "")
        modified = datetime.fromtimestamp(partition.modified, timezone.utc)
        with fs.open_input_file(partition.file) as source:
            at = partition.start
            source.seek(at)
            held, pos = b"", 0
            if at > partition.first:
                # the line that the byte before belongs to is another partition's
                source.seek(at - 1)
                held, at = _after_line(source, at - 1)
            while at < partition.end:
                cut = held.find(b"\n", pos)
                while cut < 0:
                    more = source.read(BLOCK)
                    if not more:
                        return
                    held, pos, seen = held[pos:] + more, 0, len(held) - pos
                    cut = held.find(b"\n", seen)
                yield partition.file, partition.start, at, held[pos:cut].decode("utf-8", "replace"), modified
                at, pos = at + cut + 1 - pos, cut + 1

    def commit(self, end: dict) -> None:
        pass


def _complete(fs: pafs.FileSystem, info: pafs.FileInfo) -> int:
    """Bytes of a file up to and with its last line feed."""
    with fs.open_input_file(info.path) as source:
        end = info.size
        while end > 0:
            begin = max(end - BLOCK, 0)
            source.seek(begin)
            cut = source.read(end - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            end = begin
    return 0


def _after_line(source, at: int) -> tuple[bytes, int]:
    """What has been read behind the next line feed, and its place."""
    while more := source.read(BLOCK):
        cut = more.find(b"\n")
        if cut >= 0:
            return more[cut + 1 :], at + cut + 1
        at += len(more)
    return b"", at


def growing_lines(spark: SparkSession, path: str, group: Column | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream of lines (log_group, file, chunk, line_no, line, modified); the parent folder names the log group."""
    spark.dataSource.register(GrowingFiles)
    lines = spark.readStream.format("growing_files").option("split_bytes", split_bytes).load(path)
    group = F.regexp_extract("file", r"([^/]+)/[^/]*$", 1) if group is None else group
    return lines.select(group.alias("log_group"), *[c.split()[0] for c in SCHEMA.split(", ")])
