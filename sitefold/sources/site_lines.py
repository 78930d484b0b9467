"""A data source for lines of sorted site files: ``spark.read.format("site_lines")`` after :func:`register`.

Files are read in splits, gzipped ones whole; every row has its file, its byte offset as ``line_no`` (so lines are in order without being
counted), its first field as ``chr`` and the line. Parsers of :mod:`sitefold.sources.text` take such rows. Filters on ``chr`` (=, IN) are
pushed down: with the option ``sorted`` = true (files in order of chr, as ``out_of_order`` tells) a task looks at the first and
the last site of its split and leaves out the rest if no wanted chromosome lies between.

Files are opened by pyarrow's file systems. A store that only Spark reads is served by ``text.read_lines``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "file string, line_no long, chr string, value string"
#: Bytes of a split, of a read, and of the look at an end; lines of a batch.
SPLIT, READ, PEEK, BATCH = 32 << 20, 1 << 20, 1 << 16, 4096


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    size: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def splits(path: str, split: int) -> list[Split]:
    """Of a file, or of all files of a folder but hidden ones."""
    system, inner = _opened(path)
    prefix = path.removesuffix("/")
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        files = [(prefix + f.path[len(inner.rstrip("/")) :], f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    elif info.type == fs.FileType.File:
        files = [(path, info.size)]
    else:
        raise FileNotFoundError(path)
    return [Split(p, a, size if p.endswith(".gz") else min(a + split, size), size) for p, size in sorted(files) for a in range(0, size, size if p.endswith(".gz") else split)]


def chromosome(line: bytes) -> bytes | None:
    """The first field; none of comments and empty lines."""
    fields = line.split(None, 1)
    return None if not fields or fields[0].startswith(b"#") else fields[0]


def lines_from(file, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Offset and text of the lines that begin at ``start`` or later and before ``end``."""
    at = max(0, start - 1)  # a line begins at start if the byte before ends one
    file.seek(at)
    rest, skip = b"", start > 0
    while at < end or rest:
        block = file.read(min(READ, size - at - len(rest))) if at + len(rest) < size else b""
        rest += block
        *whole, rest = rest.split(b"\n") if block else [*rest.split(b"\n"), b""]
        for line in whole:
            if not skip and at < end:
                yield at, line.removesuffix(b"\r")
            skip = False
            at += len(line) + 1
        if not block:
            return


def ends(file, part: Split) -> tuple[bytes, bytes] | None:
    """Chromosomes of the first and the last site of a split, or none if a look at both ends does not show them."""
    first = last = None
    for _, line in lines_from(file, part.start, min(part.end, part.start + PEEK), min(part.size, part.start + 2 * PEEK)):
        if (first := chromosome(line)) is not None:
            break
    for _, line in lines_from(file, max(part.start, part.end - PEEK), part.end, part.size):
        last = chromosome(line) or last
    return None if first is None or last is None else (first, last)


def read_split(part: Split, wanted: set[str] | None, in_order: bool) -> Iterator[tuple[str, int, str | None, str]]:
    system, inner = _opened(part.path)
    names = None if wanted is None else {w.encode() for w in wanted}
    if part.path.endswith(".gz"):
        with system.open_input_stream(inner, compression="gzip") as stream:
            at, rest = 0, b""
            while block := stream.read(READ):
                *whole, rest = (rest + block).split(b"\n")
                for line in whole:
                    yield from _row(part.path, at, line.removesuffix(b"\r"), names)
                    at += len(line) + 1
            yield from _row(part.path, at, rest, names) if rest else ()
        return
    with system.open_input_file(inner) as file:
        if names is not None and in_order and (span := ends(file, part)) and not any(span[0] <= n <= span[1] for n in names):
            return
        for at, line in lines_from(file, part.start, part.end, part.size):
            if line or at < part.size:
                yield from _row(part.path, at, line, names)


def _row(path: str, at: int, line: bytes, names: set[bytes] | None) -> Iterator[tuple]:
    told = chromosome(line)
    if names is None or told in names:
        yield path, at, None if told is None else told.decode(), line.decode()


class SiteLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "site_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SiteLinesReader(self.options)


class SiteLinesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.in_order, self.wanted = options.get("sorted", "false").lower() == "true", None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != ("chr",):
                yield f
            else:
                self.wanted = values if self.wanted is None else self.wanted & values

    def partitions(self) -> list[Split]:
        return splits(self.path, self.split)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        some: list[tuple] = []
        schema = pa.schema([("file", pa.string()), ("line_no", pa.int64()), ("chr", pa.string()), ("value", pa.string())])
        for row in read_split(partition, self.wanted, self.in_order):
            some.append(row)
            if len(some) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SiteLines)
