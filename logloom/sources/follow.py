"""Log files read at the byte: a Python data source that tails files and follows them as they grow.

``spark.read.format("logfiles")`` reads whole files in splits, or with ``tail=N`` only the last N lines of every file,
found by reading backwards from its end in blocks, so the bytes read do not grow with the file (gzip files cannot be
read backwards and are read whole, keeping N lines at a time). ``spark.readStream.format("logfiles")`` follows files:
its offsets are, per file, the byte after the last complete line that was handed out, so lines appended between two
triggers arrive in the next one, and a line that is still being written waits for its end. ``backfill=N`` starts every
file that exists at the first trigger at its last N lines; files that appear later are read from their start.

Rows are ``(source, file, seq, raw)``: ``seq`` is the byte offset of the line's first byte in its file, so ``(file,
seq)`` names a line exactly and for ever; ``source`` is the file's name without log, rotation and gzip suffixes (for
gzip, ``seq`` counts bytes of the unzipped text). Lines end at ``\\n``, ``\\r\\n`` or a lone ``\\r``, as Spark's text
reader has it; bytes that are not UTF-8 are replaced. A file that shrinks while followed is read again from its start.
Only the listing and the places of line ends are worked out on the driver; tasks read the bytes. Files are opened
through pyarrow's file systems, so local paths, ``file://`` and the stores pyarrow knows (HDFS, S3, GCS) work alike.
"""

from __future__ import annotations

import fnmatch
import glob
import gzip
import os
import re
import sys
from collections import deque
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from logloom.sources.files import FILE_SUFFIX, arrival_key
from logloom.workers import ship_package

SCHEMA = "source string, file string, seq long, raw string"
#: Bytes one task reads of a file at most; lines that start in a split belong to it.
SPLIT_BYTES = 64 << 20
_BLOCK = 1 << 16
_ENDS = re.compile(rb"\r\n|\r|\n")


def _store(path: str):
    """(file system, path in it, prefix that turns such a path back into a name every worker can open)."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), urlparse(path).path, ""
    if "://" in path:
        store, inner = pafs.FileSystem.from_uri(path)
        return store, inner, path.split("://", 1)[0] + "://"
    return pafs.LocalFileSystem(), os.path.abspath(path), ""


def _open(name: str):
    store, inner, _ = _store(name)
    return store.open_input_file(inner)


def listing(path: str) -> list[str]:
    """Files of a directory or glob, oldest first (rotated ones from the highest number down); names that start with
    ``_`` or ``.`` are left out, as Spark's readers do. A path that names nothing is an error."""
    store, inner, prefix = _store(path)
    info = store.get_file_info(inner)
    if info.type == pafs.FileType.Directory:
        entries = store.get_file_info(pafs.FileSelector(inner))
    elif info.type == pafs.FileType.File:
        entries = [info]
    elif glob.has_magic(inner):
        folder, pattern = inner.rsplit("/", 1)
        entries = [e for e in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if fnmatch.fnmatchcase(e.base_name, pattern)]
    else:
        raise FileNotFoundError(path)
    files = [prefix + e.path for e in entries if e.type == pafs.FileType.File and not e.base_name.startswith(("_", "."))]
    return sorted(files, key=arrival_key)


def _source(path: str) -> str:
    return re.sub(FILE_SUFFIX, "", os.path.basename(path))


def _lines_of(data: bytes, base: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of every line in ``data``; a last line without an end is a line too."""
    at = 0
    for end in _ENDS.finditer(data):
        yield base + at, data[at : end.start()]
        at = end.end()
    if at < len(data):
        yield base + at, data[at:]


def _complete_end(handle, start: int, size: int) -> int:
    """The byte after the last line end in [start, size), or ``start`` if there is none; reads backwards."""
    at = size
    while at > start:
        begin = max(start, at - _BLOCK)
        handle.seek(begin)
        block = handle.read(at - begin)
        cut = max(block.rfind(b"\n"), block.rfind(b"\r"))
        if cut >= 0:
            end = begin + cut + 1
            # A \r at the very end may be the first half of \r\n: wait for the next byte.
            return end - 1 if block[cut:cut + 1] == b"\r" and end == size else end
        at = begin
    return start


def _last_lines_start(handle, size: int, n: int) -> int:
    """Where the last ``n`` lines of a file start (a last line without an end counts); reads backwards in blocks."""
    if n <= 0:
        return size
    at, tail = size, b""
    while at > 0:
        begin = max(0, at - _BLOCK)
        handle.seek(begin)
        tail = handle.read(at - begin) + tail
        at = begin
        # Line starts in the text read so far, excluding one that may be cut at its front.
        starts = [m.end() for m in _ENDS.finditer(tail)]
        starts = [s for s in starts if s < len(tail)]
        if len(starts) >= n + 1 or (at == 0 and len(starts) >= n):
            return at + starts[-n]
    return 0


class _Slice(InputPartition):
    def __init__(self, path: str, start: int, end: int, tail: int = 0):
        self.path, self.start, self.end, self.tail = path, start, end, tail


def _read(part: _Slice) -> Iterator[tuple]:
    source = _source(part.path)

    def rows(pairs):
        for offset, line in pairs:
            yield source, part.path, offset, line.decode("utf-8", "replace")

    if part.path.endswith(".gz"):
        with gzip.GzipFile(fileobj=_open(part.path)) as handle:
            data = handle.read()
        lines = _lines_of(data, 0)
        yield from rows(deque(lines, maxlen=part.tail) if part.tail else lines)
        return
    with _open(part.path) as handle:
        start = part.start
        if part.tail:
            size = handle.size()
            start = _last_lines_start(handle, size, part.tail)
            end = size
        else:
            end = part.end
        if start > 0 and not part.tail:
            # A line that began in the split before belongs to that split.
            handle.seek(start - 1)
            before = handle.read(1)
            if before not in (b"\n", b"\r"):
                rest = handle.read(max(0, end - start) + _BLOCK)
                found = _ENDS.search(rest)
                start = start + (found.end() if found else len(rest))
            elif before == b"\r" and handle.read(1) == b"\n":
                start += 1
        if start >= end:
            return
        handle.seek(start)
        data = handle.read(end - start)
        # The line that starts last may run past the split's end.
        if not part.tail and data and data[-1:] not in (b"\n", b"\r"):
            while True:
                more = handle.read(_BLOCK)
                if not more:
                    break
                found = _ENDS.search(more)
                if found:
                    data += more[: found.end()]
                    break
                data += more
        yield from rows(_lines_of(data, start))


def _splits(path: str, start: int, end: int) -> list[_Slice]:
    if path.endswith(".gz"):
        return [_Slice(path, 0, end)] if start == 0 and end > 0 else []
    return [_Slice(path, s, min(s + SPLIT_BYTES, end)) for s in range(start, end, SPLIT_BYTES)]


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tail = options["path"], int(options.get("tail", 0))

    def partitions(self) -> list[InputPartition]:
        files = listing(self.path)
        if self.tail:
            return [_Slice(f, 0, 0, self.tail) for f in files] or [_Slice("", 0, 0)]
        sized = [(f, _open(f).size()) for f in files]
        return [s for f, size in sized for s in _splits(f, 0, size)] or [_Slice("", 0, 0)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        if partition.path:
            yield from _read(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.backfill = options["path"], int(options.get("backfill", 0))

    def _ends(self, starts: dict) -> dict:
        ends = {}
        for f in listing(self.path):
            with _open(f) as handle:
                size = handle.size()
                if f.endswith(".gz"):
                    ends[f] = size  # read whole once it appears
                    continue
                start = starts.get(f, 0)
                ends[f] = _complete_end(handle, 0 if start > size else start, size)
        return ends

    def initialOffset(self) -> dict:
        starts = {}
        if self.backfill:
            for f in listing(self.path):
                if not f.endswith(".gz"):
                    with _open(f) as handle:
                        size = handle.size()
                        starts[f] = _last_lines_start(handle, _complete_end(handle, 0, size), self.backfill)
        return {"files": starts}

    def latestOffset(self) -> dict:
        known = getattr(self, "_latest", None) or self.initialOffset()
        self._latest = {"files": {**known["files"], **self._ends(known["files"])}}
        return self._latest

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = []
        for f, stop in end["files"].items():
            begin = start["files"].get(f, 0)
            if stop < begin:  # shrunk: from its start again
                begin = 0
            parts += _splits(f, begin, stop) if not f.endswith(".gz") or f not in start["files"] else []
        return parts

    def read(self, partition: _Slice) -> Iterator[tuple]:
        if partition.path:
            yield from _read(partition)

    def commit(self, end: dict) -> None:
        pass


class LogFiles(DataSource):
    """``format("logfiles")``: see the module docstring."""

    @classmethod
    def name(cls) -> str:
        return "logfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("logfiles")`` known to the session; workers get this package with it."""
    ship_package(spark)
    # The driver plans streams in a Python process of its own that has not got the package: send the code itself.
    for module in (sys.modules[__name__], sys.modules[arrival_key.__module__]):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(LogFiles)


def tail_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last ``n`` lines of every file, read from its end. Offsets above 2^44 are an error."""
    register(spark)
    return spark.read.format("logfiles").option("tail", n).load(path)


def follow_lines(spark: SparkSession, path: str, backfill: int = 0) -> DataFrame:
    """Lines of the files under ``path`` as they are written, each once, with its exact place."""
    register(spark)
    return spark.readStream.format("logfiles").option("backfill", backfill).load(path)
