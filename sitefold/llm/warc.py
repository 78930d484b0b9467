"""WARC archives of crawled pages, and a globally ordered index of their captures by an external merge.

Writing: of records with equal payloads (of at least ``min_bytes``) the one with the smallest id keeps the payload, the others are
``revisit`` records that refer to it. Equal payloads are told by their SHA-256; only repeated ones are joined back, salted, so that
a payload of which there are millions of copies is no key of one task. Every record is a gzip member of its own. Spark's text
writer puts them into files: bytes pass through it unchanged, and the separator it wants between rows is an empty gzip member,
which readers of gzip skip. So archives are written wherever Spark writes, with its commits, and are legal ``.warc.gz`` files.

Reading: each archive is parsed member by member, lengths and payload digests are checked, and its captures are sorted by
URL key, time and id: a run. Runs are written; then captures are dealt to ranges of (key, time, id, archive, offset), so that one URL
with most captures is cut by time, and each range merges the runs' pieces with a tree of losers. Pieces wait in an
unnamed spill file of the task; at most ``FAN`` are merged at once, with one chunk of each in memory. Ranges in order of
their partitions are the whole index in order.

Defined results: a null payload is empty; a null URL has no target line and the empty key; control characters and spaces in a URL
are written as percent escapes; a null id is never the smallest: it refers to the smallest id of its payload, and is a response where all
ids are null; rows that repeat id and payload are the same record, so all with the smallest id are responses; no rows give
no archives and an empty index; other columns are not carried.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import bounded_batches, materialize, partitions_for, read_table, shared_dir

#: Payload bytes of an archive; captures of a range; runs that are merged at once; rows of a chunk; salts of repeated payloads.
ARCHIVE_BYTES, RANGE, FAN, CHUNK, SALTS = 32 << 20, 1 << 17, 256, 1024, 64
#: Least payload that can be a revisit, and the second of the first capture where pages do not tell theirs (2024-01-01).
MIN_BYTES, FIRST_SECOND = 0, 1_704_067_200
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "archive string, offset long, length long, url_key string, captured_at string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
FIELDS = [f.split()[0] for f in CAPTURE.split(", ")]
_ARROW = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in CAPTURE.split(", ")])


# Writing


def with_first(pages: DataFrame, min_bytes: int, archives: int) -> DataFrame:
    """page_id, url, second and payload of pages (page_id, url, second, html), with ``first``: for revisits the id they refer to."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "second", payload.alias("payload"), F.when(F.length(payload) >= min_bytes, F.sha2(payload, 256)).alias("same"))
    again = rows.where("same is not null").groupBy("same").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    again = again.select("same", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # a payload too short to be looked for has a key of its own row
    salted = rows.withColumns({"same": F.coalesce("same", F.lit("")), "salt": F.pmod(F.xxhash64("page_id", "url", "second"), F.when(F.col("same").isNull(), F.lit(1 << 20)).otherwise(F.lit(SALTS))).cast("int")})
    dealt = salted.repartition(archives, "same", "salt").join(again, ["same", "salt"], "left")
    return dealt.select("page_id", "url", "second", "payload", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("first"))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, second: int, payload: bytes, first: int | None) -> bytes:
    """One record, as it is before compression."""
    name = lambda n: f"<urn:page:{'' if n is None else n}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url))
    lines += [f"WARC-Date: {datetime.fromtimestamp(second, timezone.utc):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if first is not None:
        lines += [f"WARC-Refers-To: {name(first)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def information() -> bytes:
    """The record that every archive begins with."""
    block = b"software: sitefold\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:sitefold:archive>\r\nWARC-Date: {datetime.fromtimestamp(FIRST_SECOND, timezone.utc):%Y-%m-%dT%H:%M:%SZ}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}"
    return head.encode() + _END + block + _END


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """pages: page_id, url, html and ``second`` (of the capture, since 1970)."""
    spark = pages.sparkSession
    bounded_batches(spark)
    total = int(pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0)
    rows = with_first(pages, min_bytes, partitions_for(spark, total, archive_bytes))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            made = [] if begun else [information()]
            begun = True
            made += [record(*row) for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "second", "payload", "first")], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(m, 6, mtime=0) for m in made], pa.binary())], names=["value"])

    told = rows.mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value"))
    told.write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("latin-1")).text(path)


# Reading


def archive_members(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member that is not empty."""
    view, at = memoryview(raw), 0
    while at < len(view):
        inflate, parts, end = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if end >= len(view):
                raise ValueError("the archive ends within a record")
            parts.append(inflate.decompress(view[end : end + 16_384]))
            end = min(end + 16_384, len(view))
        end -= len(inflate.unused_data)
        if data := b"".join(parts):
            yield at, end - at, data
        at = end


def _fields(head: bytes) -> dict[str, str]:
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of the record and of its HTTP head, and the payload it holds."""
    head, _, rest = data.partition(_END)
    fields = _fields(head)
    length = int(fields["content-length"])
    if not head.startswith(b"WARC/1.") or rest[length:] != _END:
        raise ValueError("no WARC record of the length it tells")
    if "http" not in fields["content-type"]:
        return fields, {}, rest[:length]
    http, _, payload = rest[:length].partition(_END)
    return fields, _fields(http), payload


def url_key(url: str) -> str:
    """Labels of the host from the last to the first, then the path and the query."""
    rest = url.partition("://")[2] if "://" in url else url
    host, tail = re.match(r"([^/?#]*)([^#]*)", rest).groups()
    return f"{','.join(reversed(host.lower().split('.')))}){tail or '/'}" if host else ""


def _name(text: str) -> int | None:
    number = re.fullmatch(r"<urn:page:(-?\d*)>", text)[1]
    return int(number) if number else None


def captures(archive: str, raw: bytes) -> Iterator[tuple]:
    """The captures of an archive (FIELDS) as they lie in it. A digest that is not the payload's is an error."""
    for offset, length, data in archive_members(raw):
        fields, http, payload = parse_record(data)
        if fields["warc-type"] not in ("response", "revisit"):
            continue
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "response" and (payload_digest(payload), len(payload)) != (digest, int(http["content-length"])):
            raise ValueError(f"{archive}, {offset}: the payload is not what its digest and length tell")
        url = fields.get("warc-target-uri")
        refers_to = _name(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
        yield (archive, offset, length, url_key(url or ""), re.sub(r"\D", "", fields["warc-date"]), _name(fields["warc-record-id"]), url, fields["warc-type"], int(http["content-length"]), digest, refers_to)


def order(capture: tuple) -> tuple:
    """URL key, time, id (none first), archive and offset."""
    archive, offset, _, key, at, page_id = capture[:6]
    return key, at, page_id is not None, page_id or 0, archive, offset


def _batches(rows: Iterator[tuple], size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield _batch(some)
            some = []
    if some:
        yield _batch(some)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _rows(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*[batch.column(c).to_pylist() for c in FIELDS], strict=True))


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``, each archive's in order: one run an archive."""
    bounded_batches(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                archive = batch.column("path")[i].as_py().rpartition("/")[2]
                yield from _batches(iter(sorted(captures(archive, batch.column("content")[i].as_py()), key=order)))

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(read, CAPTURE)


# Merging


def losers_merge(sources: list[Iterator[tuple]], key: Callable[[tuple], tuple] = order) -> Iterator[tuple]:
    """The rows of sorted sources in order. Inner nodes of the tree keep the loser of the match below them, so each row that goes
    out costs one match a level."""
    k = len(sources)
    rows = [next(s, None) for s in sources]
    keys = [None if r is None else key(r) for r in rows]
    losers = [0] * k

    def beats(a: int, b: int) -> bool:
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and (keys[a] is not None or a < b)
        return (keys[a], a) < (keys[b], b)

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while k and keys[best] is not None:
        yield rows[best]
        rows[best] = next(sources[best], None)
        keys[best] = None if rows[best] is None else key(rows[best])
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


class Spool:
    """Sorted runs in an unnamed file: lists of places of their chunks."""

    def __init__(self, file):
        self.file, self.runs, self.last = file, [], {}

    def _put(self, rows: list[tuple]) -> tuple[int, int]:
        data = _batch(rows).serialize()
        at = self.file.seek(0, 2)
        self.file.write(data)
        return at, data.size

    def add(self, rows: list[tuple]) -> None:
        """Rows of one archive that came together: they go on with its run where they ascend, and begin another where not."""
        cut = [0, *(i for i in range(1, len(rows)) if order(rows[i]) < order(rows[i - 1])), len(rows)]
        for a, b in zip(cut, cut[1:], strict=False):
            run, top = self.last.get(rows[a][0], (None, None))
            if run is None or order(rows[a]) < top:
                run = len(self.runs)
                self.runs.append([])
            self.runs[run] += [self._put(rows[i : min(i + CHUNK, b)]) for i in range(a, b, CHUNK)]
            self.last[rows[a][0]] = run, order(rows[b - 1])

    def _read(self, run: list[tuple[int, int]]) -> Iterator[tuple]:
        for at, size in run:
            self.file.seek(at)
            yield from _rows(pa.ipc.read_record_batch(pa.py_buffer(self.file.read(size)), _ARROW))

    def merged(self, fan: int) -> Iterator[tuple]:
        while len(self.runs) > fan:
            groups = [self.runs[i : i + fan] for i in range(0, len(self.runs), fan)]
            self.runs = [[self._put(_rows(b)) for b in _batches(losers_merge([self._read(r) for r in g]))] for g in groups]
        return losers_merge([self._read(r) for r in self.runs])


def merged_runs(runs: DataFrame, ranges: int, fan: int = FAN) -> DataFrame:
    """All captures in order: partitions are ranges, and their order is that of the ranges."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as file:
            spool = Spool(file)
            for batch in batches:
                rows, a = _rows(batch), 0
                for b in range(1, len(rows) + 1):
                    if b == len(rows) or rows[b][0] != rows[a][0]:
                        spool.add(rows[a:b])
                        a = b
            yield from _batches(spool.merged(fan))

    return runs.repartitionByRange(ranges, "url_key", "captured_at", "page_id", "archive", "offset").mapInArrow(merge, CAPTURE)


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of the archives under ``path``, in order (CAPTURE)."""
    runs = materialize(sorted_runs(spark, path), "runs")
    return merged_runs(runs, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE)))


def write_index(index: DataFrame, path: str) -> None:
    """A line a capture: key, time and the rest as JSON. Part files in order of their names are in order."""
    rest = F.to_json(F.struct("url", "page_id", F.col("record_type").alias("type"), F.col("payload_digest").alias("digest"), "payload_bytes", "refers_to", F.col("archive").alias("filename"), "offset", "length"))
    index.select(F.concat_ws(" ", "url_key", "captured_at", rest).alias("value")).write.text(path)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    second: Column = F.lit(FIRST_SECOND) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 31))
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html", second.alias("second"))
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return capture_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Five bytes of the digest are eight digits of base 32.
OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html),
h AS (SELECT page_id, html, first_id, sha1(html) AS hex FROM p JOIN f USING (html))
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + (i // 8) * 10, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM h
"""
