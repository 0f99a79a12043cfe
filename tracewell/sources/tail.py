"""A stream over text logs that grow: a cursor of file, inode and byte, which the stream's checkpoint keeps.

Each complete line is read once, over restarts, and also where a log is rotated: a renamed file keeps its inode and is read on to its end under its new name, and the new file of the old name begins at its first byte.
A file that has become shorter than what was read of it, or begins otherwise than it did, was written anew and is read from its beginning.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tracewell.sources.records import Header, header

SCHEMA = "value string, path string, at long, sep string, fields string, fields_sep string"
#: By so many first bytes a file is known again.
HEAD = 512
#: Header lines are looked for in so many first bytes.
TOP = 1 << 16
ROWS = 5000


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin in a range of bytes; ``start`` is where the file's own range begins, at a line."""

    folder: str
    file: str
    name: str
    start: int
    begin: int
    end: int
    whole: bool


def _key(st: os.stat_result) -> str:
    return f"{st.st_dev}:{st.st_ino}"


def _lines_end(f, size: int) -> int:
    """The byte after the last line end within the first ``size`` bytes."""
    at = size
    while at > 0:
        step = min(at, 1 << 16)
        f.seek(at - step)
        found = f.read(step).rfind(b"\n")
        if found >= 0:
            return at - step + found + 1
        at -= step
    return 0


def _head(f, n: int) -> int:
    f.seek(0)
    return zlib.crc32(f.read(n))


def _find(folder: str, file: str) -> str | None:
    """Where a file is now, by its inode."""
    for entry in os.scandir(folder):
        if entry.is_file() and _key(entry.stat()) == file:
            return entry.path
    return None


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.pattern = re.sub(r"^file:/+", "/", options["path"]), options.get("pattern", "dns*.log")
        self.split = int(options.get("splitBytes", 64 << 20))
        self.whole = str(options.get("failOnDataLoss", "true")).lower() == "true"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """By inode: name, end of the last complete line, and the length and checksum of the file's beginning."""
        found = {}
        for entry in sorted(os.scandir(self.folder), key=lambda e: e.name):
            if not fnmatch(entry.name, self.pattern) or not entry.is_file():
                continue
            try:
                with open(entry.path, "rb") as f:
                    st = os.fstat(f.fileno())
                    if end := _lines_end(f, st.st_size):
                        n = min(HEAD, end)
                        found[_key(st)] = [entry.name, end, n, _head(f, n)]
            except FileNotFoundError:  # renamed since it was listed: the next turn finds it
                continue
        return dict(sorted(found.items()))

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        for file, (name, stop, _, _) in end.items():
            at = _find(self.folder, file)
            begin = 0
            if file in start:
                _, read, n, crc = start[file]
                if at is None:
                    begin = read
                elif read <= stop:
                    with open(at, "rb") as f:
                        begin = read if _head(f, n) == crc else 0
            pieces += [Piece(self.folder, file, name, begin, k, min(k + self.split, stop), self.whole) for k in range(begin, stop, self.split)]
        return pieces or [Piece(self.folder, "", "", 0, 0, 0, self.whole)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.end <= p.begin:
            return
        at = _find(p.folder, p.file)
        if at is None or os.path.getsize(at) < p.end:
            if p.whole:
                raise OSError(f"{p.name} has gone or was cut after its lines were counted; option failOnDataLoss false leaves such lines out")
            if at is None:
                return
        with open(at, "rb") as f:
            held: Header = (None, None, None)
            for line in f.read(TOP).split(b"\n")[:-1] if p.begin else ():
                text = line.decode("utf-8", "ignore").rstrip("\r")
                if text.strip() and not text.startswith("#"):
                    break
                held = header(text, held)
            f.seek(p.begin)
            if p.begin > p.start:  # a line belongs to the range in which it begins
                f.seek(p.begin - 1)
                f.readline()
            rows: list[tuple] = []
            while (where := f.tell()) < p.end and (line := f.readline()):
                text = line.decode("utf-8", "ignore").rstrip("\r\n")
                held = header(text, held)
                rows.append((text, p.name, where, *held))
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


_ARROW = pa.schema([("value", pa.string()), ("path", pa.string()), ("at", pa.int64()), ("sep", pa.string()), ("fields", pa.string()), ("fields_sep", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW, strict=True)], schema=_ARROW)


class Tail(DataSource):
    """Format ``log_tail``: options ``path``, a folder that the driver and all executors see, ``pattern`` of file names, ``splitBytes``, ``failOnDataLoss``.

    A row is a complete line with its file's name then, its first byte, and the header that holds for it, as `parse_lines` takes it: that above it in the same range of bytes, or else at the top of the file.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail(spark: SparkSession, folder: str, pattern: str = "dns*.log", **options: str | int) -> DataFrame:
    """The lines of the logs in ``folder`` as a stream."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("log_tail").options(path=folder, pattern=pattern, **options).load()
