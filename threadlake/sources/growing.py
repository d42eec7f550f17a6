"""A streaming source of the lines of files that grow, shrink and are rotated.

An offset is, for each file, its inode and the byte after the last whole line. A batch has the bytes between two offsets; a file
whose inode changed, or that is shorter than before, begins anew at 0. A file that was only renamed goes on where it was. The line
that is still being written, without its newline, waits for a later batch. Ranges are cut in pieces of PIECE bytes, so that a file
of any size is read by many tasks, each a batch of rows at a time.

The folder must be one that the driver and all executors see under the same path. A file that shrinks and grows past its old length
between two batches looks like one that grew.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from glob import glob

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PIECE = 32 << 20
BLOCK = 1 << 16
ROWS = 2_000

SCHEMA = "file string, inode long, offset long, line string"
_ARROW = pa.schema([("file", pa.string()), ("inode", pa.int64()), ("offset", pa.int64()), ("line", pa.string())])


@dataclass
class Piece(InputPartition):
    """Lines that begin in [start, end) of a range that begins at a line."""

    file: str
    inode: int
    first: int
    start: int
    end: int


def whole_lines(path: str, size: int) -> int:
    """The byte after the last newline among the first `size`; looks back only as far as that."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            begin = max(0, at - BLOCK)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return 0


def ranges(start: dict, end: dict) -> list[tuple[str, int, int, int]]:
    """(file, inode, from, to) of what is new at `end`."""
    by_inode = {inode: offset for inode, offset in start.values()}
    out = []
    for file, (inode, offset) in sorted(end.items()):
        before = by_inode.get(inode, 0)
        since = before if before <= offset else 0
        if offset > since:
            out.append((file, inode, since, offset))
    return out


class GrowingFilesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern = os.path.join(options["path"].removeprefix("file://"), options.get("pattern", "*.jsonl"))
        self.piece = int(options.get("pieceBytes", PIECE))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path in sorted(glob(self.pattern, recursive=True)):
            try:
                stat = os.stat(path)
                out[path] = [stat.st_ino, whole_lines(path, stat.st_size)]
            except FileNotFoundError:
                continue  # gone since it was listed
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [Piece(file, inode, a, at, min(at + self.piece, b)) for file, inode, a, b in ranges(start, end) for at in range(a, b, self.piece)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        p = partition
        with open(p.file, "rb") as f:
            f.seek(p.start)
            if p.start > p.first:  # the line that reaches into this piece belongs to the one before
                f.seek(p.start - 1)
                f.readline()
            rows: list[tuple[int, str]] = []
            while (at := f.tell()) < p.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    break
                if line.strip():
                    rows.append((at, line.rstrip(b"\r\n").decode("utf-8", "replace")))
                if len(rows) == ROWS:
                    yield self._batch(p, rows)
                    rows = []
            if rows:
                yield self._batch(p, rows)

    @staticmethod
    def _batch(p: Piece, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        offsets, lines = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([p.file] * len(rows)), pa.array([p.inode] * len(rows), pa.int64()), pa.array(offsets, pa.int64()), pa.array(lines)], schema=_ARROW)

    def commit(self, end: dict) -> None:
        pass


class GrowingFiles(DataSource):
    """`spark.readStream.format("growing_files").option("pattern", "**/*.jsonl").load(folder)` once it is registered."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingFilesReader:
        return GrowingFilesReader(self.options)
