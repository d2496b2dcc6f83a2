"""Lines appended to log files, as a streaming source: ``spark.readStream.format("log_tail")``.

An offset says, for every file, up to which byte its complete lines have been read, and how the file begins. A file that has grown is read on
from there. A file is known by its beginning: one that was renamed (rotated) is read on under its new name, and one whose
beginning has changed (truncated, or a new file under an old name) is read from its first byte. A line without its line end waits. Each line
comes once, also when a query is started again from its checkpoint; long ranges are dealt to several tasks.

Options: ``path`` is a file, a folder, or a pattern in its last part; folders of any file system that ``pyarrow.fs`` reaches.
``startingPosition``: ``earliest`` (default) or ``latest`` (lines written before the start are not read). ``splitBytes``: bytes a task reads at most, about.

Files with the same first ``HEAD`` bytes are told apart by name only. A file that is missing in one listing and comes back counts as new. If a file has gone
before its lines were read, the query fails rather than skipping them. Bytes that are not UTF-8 become replacement characters.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD = 256
BLOCK = 1 << 20
SPLIT_BYTES = 32 << 20
BATCH_LINES = 10_000
SCHEMA = "file string, position bigint, value string"


@dataclass
class Range(InputPartition):
    """Bytes of a file, from one line's start to another's; ``head``: how the file began when the range was planned."""

    path: str
    head: str
    start: int
    stop: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(system: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    if "*" in path or "?" in path:
        folder, pattern = posixpath.split(path)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)]
    info = system.get_file_info(path)
    if info.type == fs.FileType.Directory:
        return [f for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return [info] if info.type == fs.FileType.File else []


def _head(stream) -> str:
    stream.seek(0)
    return stream.read(HEAD).hex()


def _complete(stream, size: int) -> int:
    """Bytes up to the end of the last complete line."""
    end = size
    while end > 0:
        start = max(0, end - BLOCK)
        stream.seek(start)
        at = stream.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


def snapshot(path: str) -> dict:
    """Offset at the present: for each file the end of its complete lines and its beginning."""
    system, inner = _opened(path)
    out = {}
    for info in sorted(_files(system, inner), key=lambda f: f.path):
        with system.open_input_file(info.path) as stream:
            size = stream.size()
            out[info.path] = {"end": _complete(stream, size), "head": _head(stream)[: 2 * size]}
    return out


def matched(start: dict, end: dict) -> Iterator[tuple[str, int]]:
    """Each file of the later offset and the byte up to which it was read before."""
    before = dict(start)

    def same(old: dict, new: dict) -> bool:
        return bool(old["head"]) and new["head"].startswith(old["head"]) and new["end"] >= old["end"]

    kept = {path: before.pop(path)["end"] for path in list(before) if path in end and same(before[path], end[path])}
    for path, new in end.items():
        if path not in kept:
            renamed = max((old for old in before if same(before[old], new)), key=lambda old: (len(before[old]["head"]), before[old]["end"]), default=None)
            kept[path] = before.pop(renamed)["end"] if renamed is not None else 0
    yield from ((path, kept[path]) for path in end)


def _lines(system: fs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """Lines that begin in the range, with their positions; a range inside a file begins with the first line that starts in it."""
    with system.open_input_file(part.path) as stream:
        at = part.start
        stream.seek(max(0, at - 1))
        rest = b""
        if at:
            # The byte before tells whether a line starts right here.
            skipping = stream.read(1) != b"\n"
            while skipping:
                block = stream.read(BLOCK)
                if not block:
                    return
                cut = block.find(b"\n")
                skipping, at = cut < 0, at + (len(block) if cut < 0 else cut + 1)
                rest = b"" if cut < 0 else block[cut + 1 :]
        while at < part.stop:
            cut = rest.find(b"\n")
            if cut < 0:
                pieces = [rest]
                while True:  # a long line is gathered once
                    block = stream.read(BLOCK)
                    if not block:
                        return
                    pieces.append(block)
                    if b"\n" in block:
                        break
                rest = b"".join(pieces)
                cut = rest.find(b"\n")
            begin = 0
            while cut >= 0 and at < part.stop:
                yield at, rest[begin:cut]
                at += cut + 1 - begin
                begin = cut + 1
                cut = rest.find(b"\n", begin)
            rest = rest[begin:]


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}  # as everywhere in Spark, case does not matter
        if "path" not in options:
            raise ValueError("log_tail needs a path")
        self.path, self.position = options["path"], options.get("startingposition", "earliest")
        if self.position not in ("earliest", "latest"):
            raise ValueError("startingPosition is earliest or latest")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:
        return {"files": snapshot(self.path) if self.position == "latest" else {}}

    def latestOffset(self) -> dict:
        return {"files": snapshot(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, read in matched(start["files"], end["files"]):
            stop, head = end["files"][path]["end"], end["files"][path]["head"]
            out += [Range(path, head, a, min(a + self.split, stop)) for a in range(read, stop, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, inner = _opened(self.path)
        partition = self._found(system, inner, partition)
        rows: list[tuple[str, int, str]] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], ["file", "position", "value"])

        size = 0
        for at, line in _lines(system, partition):
            rows.append((partition.path, at, line.removesuffix(b"\r").decode("utf-8", "replace")))
            size += len(line)
            if len(rows) >= BATCH_LINES or size > 8 * BLOCK:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    def _found(self, system: fs.FileSystem, inner: str, part: Range) -> Range:
        """The range under the name the file has now; it may have been rotated since the range was planned."""
        names = [part.path, *(f.path for f in _files(system, inner) if f.path != part.path)]
        for name in names:
            if system.get_file_info(name).type != fs.FileType.File:
                continue
            with system.open_input_file(name) as stream:
                if stream.size() >= part.stop and _head(stream).startswith(part.head):
                    return Range(name, part.head, part.start, part.stop)
        raise FileNotFoundError(f"{part.path} has gone or was cut before bytes {part.start} to {part.stop} were read")

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogTailReader(dict(self.options))


def tail_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Stream of the lines of growing files, with ``file`` and ``position``."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").options(path=path, **options).load()
