"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts earlier are removed.

A string starts earlier in a document with a smaller doc_id, or in the same document at a smaller offset. Suffixes are
sorted by external induced sorting (:mod:`._induced`), shard by shard. So that shards are independent and no larger than
what can repeat, every start of a string belongs to an anchor: the k-gram with the smallest hash in the string, which
equal strings choose alike. Anchors are dealt to shards by that hash, so all copies of a string meet in one shard.

* An anchor comes with the hash of the bytes its strings cover together. Where an earlier anchor has both hashes, it is the
  same piece of text, of which only the first is sorted; tasks combine such pieces before they are sent, so a passage in a
  third of all documents is sent once a task.
* An anchor whose k-gram occurs nowhere else with other surroundings has nothing to be compared with.
* The bytes around the remaining anchors, the first of their kind each, make up the shard: its suffixes are sorted with
  common-prefix values, and in every run of suffixes with ``LENGTH`` bytes in common all but the earliest are repeats. A
  shard is written to disk as its pieces arrive in order, and sorted there beyond ``BUDGET`` bytes.
* A k-gram with more than ``HOT`` kinds of surroundings would be one large shard, and one with more than ``OFTEN`` of them in what one
  task combines (a passage in many documents, each time with other text around it) would fill its bucket of anchors, too: the
  task sends a mark there instead, and all anchors of a marked k-gram count as hot wherever they are. Their strings are told by two hashes of the whole
  string instead (64 and 32 bits). Equal strings are combined twice, in each task and then by hash, and no bytes travel: of a
  passage in a third of all documents a task sends each string once, and one run of starts for each further copy.

Defined results: a null text is empty, with no bytes and no spans; texts shorter than ``LENGTH`` bytes lose nothing; a
null doc_id counts as the smallest; rows that repeat a doc_id are one document (equal offsets of them are no repeats of
one another, and what is removed at an offset is removed from each); empty tables give empty results; other columns pass
through, whatever their names, and those named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._induced import Store, suffixes_descending
from ._spark import bounded_batches, materialize, packed, partitions_for, read_table, text_bytes_in, unpacked
from ._words import BYTE_EXACT, mix64, powers, prefix_sums, range_hash, text_bytes, tidy

#: Bytes of a string, and of the k-gram that anchors it; bytes that are hashed at once; anchors that a task combines;
#: bytes of a shard's arrays that a task keeps in memory; kinds of surroundings beyond which a k-gram is hot.
LENGTH, GRAM, CHUNK, COMBINE, BUDGET, HOT = 100, 32, 1 << 19, 1 << 19, 1 << 27, 2048
#: Kinds of surroundings of one k-gram among the COMBINE anchors of a task beyond which it is hot at once.
OFTEN = 32
#: Bytes of input for each bucket of anchors, and for each shard.
BUCKET_BYTES, SHARD_BYTES = 1 << 26, 1 << 22
_PLACE = np.uint64((1 << 21) - 1)
_NULL_ID = -(1 << 63)
_BLOCK = "kind int, bucket int, docs binary, starts binary, counts binary, grams binary, wholes binary"
_NAMES = [f.split(" ")[0] for f in _BLOCK.split(", ")]
_KINDS = {"docs": np.int64, "starts": np.uint32, "counts": np.uint8, "grams": np.uint64, "wholes": np.uint64}
ANCHOR, REPEAT, LOOSE, MARK = 0, 1, 2, 3
#: Strings of hot k-grams, and runs of starts, as rows of shards hold them; what their rows have instead of a count.
_STRING = np.dtype([("hash", "<u8"), ("more", "<u4"), ("doc", "<i8"), ("start", "<u4")])
_RUN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("count", "u1")])
STRINGS, RUNS = 0, -1
_OTHER = mix64(BYTE_EXACT)


def document_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_NULL_ID))


def anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor of texts that lie one after the other: where its first string starts, how many strings it has,
    the hash of its k-gram, and the hash of all bytes of its strings with the place of the k-gram among them."""
    if len(raw) < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    width = LENGTH - GRAM + 1
    sums = prefix_sums(BYTE_EXACT[raw])
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * powers(len(sums))[1][: len(raw) - GRAM + 1])
    # the least hash wins, of equal ones the first: the place is part of what is compared
    least, span = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    room = np.repeat(at[1:], np.diff(at)) - np.arange(len(raw))
    starts = np.flatnonzero(room >= LENGTH)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    place = (least[starts] & _PLACE).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    first, place, count = starts[cut], place[cut], np.diff(np.r_[cut, len(starts)])
    about = mix64((count * 256 + (place - first)).astype(np.uint64))
    return first, count, grams[place], mix64(range_hash(sums, first, first + count - 1 + LENGTH) ^ about)


def _slices(at: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Runs of whole texts of about CHUNK bytes, and overlapping slices of longer ones: (first row, offset in its text,
    first byte, where texts start and end)."""
    row, n = 0, len(at) - 1
    while row < n:
        end = max(int(np.searchsorted(at, at[row] + CHUNK, side="right")) - 1, row + 1)
        if at[end] - at[row] <= CHUNK:
            yield row, 0, int(at[row]), at[row : end + 1] - at[row]
        else:
            size = int(at[row + 1] - at[row])
            for k in range(0, max(size - LENGTH + 1, 1), CHUNK - LENGTH):
                yield row, k, int(at[row]) + k, np.array([0, min(size - k, CHUNK - 1)])
        row = end


def _pack(kind: int, bucket: np.ndarray, buckets: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row a bucket with the packed values that belong to it."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    packed = {}
    for name, kind_of in _KINDS.items():
        if name in columns:
            values = columns[name].astype(kind_of)[order]
            packed[name] = pa.array([values[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())
        else:
            packed[name] = pa.nulls(len(full), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(full), kind, np.int32)), pa.array(full.astype(np.int32)), *packed.values()], _NAMES)


def _unpack(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        columns = [[np.frombuffer(x, _KINDS[n]) for x in batch.column(n).to_pylist()] for n in names]
        if batch.num_rows:
            yield np.repeat(batch.column("kind").to_numpy(), [len(x) for x in columns[0]]), [np.concatenate(c) for c in columns]


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix64(values.view(np.uint64)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _first_of_pairs(grams: np.ndarray, wholes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by both hashes and place, and which rows in that order are the first of their pair of hashes."""
    order = np.lexsort((starts, docs, wholes, grams))
    g, w = grams[order], wholes[order]
    return order, np.r_[True, (g[1:] != g[:-1]) | (w[1:] != w[:-1])][: len(order)]


def anchor_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed anchors of all texts by the bucket of their k-gram; those that repeat within the task by their document."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            ids, starts, counts, grams, wholes = (np.concatenate(x) for x in zip(*held, strict=True))
            order, first = _first_of_pairs(grams, wholes, ids, starts)
            ids, starts, counts, grams, wholes = (x[order] for x in (ids, starts, counts, grams, wholes))
            gram = np.cumsum(np.r_[0, grams[1:] != grams[:-1]])
            often = np.bincount(gram, weights=first)[gram] > OFTEN
            rare, many, again = first & ~often, first & often, ~first
            yield _pack(ANCHOR, _bucket(grams[rare], buckets), buckets, {"docs": ids[rare], "starts": starts[rare], "counts": counts[rare], "grams": grams[rare], "wholes": wholes[rare]})
            if many.any():
                marked = np.unique(grams[many])
                yield _pack(MARK, _bucket(marked, buckets), buckets, {"grams": marked})
                yield _pack(LOOSE, _bucket(wholes[many], buckets), buckets, {"docs": ids[many], "starts": starts[many], "counts": counts[many]})
            yield _pack(REPEAT, _bucket(ids[again], buckets), buckets, {"docs": ids[again], "starts": starts[again], "counts": counts[again]})

        size = 0
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            ids = batch.column("key").to_numpy()
            for row, offset, byte, inside in _slices(at):
                first, count, gram, whole = anchors(raw[byte : byte + int(inside[-1])], inside)
                text = np.searchsorted(inside, first, side="right") - 1
                held.append((ids[row + text], first - inside[text] + offset, count, gram, whole))
                size += len(first)
            if size >= COMBINE:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return docs.select("key", "text").mapInArrow(tidy(blocks), _BLOCK)


def compared_anchors(blocks: DataFrame, buckets: int, shards: int, hot: int = HOT) -> DataFrame:
    """Blocks of REPEAT by document for anchors that an earlier one equals; of ANCHOR by shard (one k-gram in one shard) for
    the first of each kind where a k-gram has several kinds of surroundings, or of LOOSE where it has more than ``hot`` or a mark."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        marks = [np.zeros(0, np.uint64)]
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            done = batch.filter(pa.array((kind == REPEAT) | (kind == LOOSE)))
            if done.num_rows:
                yield done
            marks += [np.frombuffer(x, np.uint64) for x in batch.filter(pa.array(kind == MARK)).column("grams").to_pylist()]
            parts += [columns for _, columns in _unpack(iter([batch.filter(pa.array(kind == ANCHOR))]), list(_KINDS))]
        if not parts:
            return
        ids, starts, counts, grams, wholes = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, first = _first_of_pairs(grams, wholes, ids, starts)
        ids, starts, counts, grams = (x[order] for x in (ids, starts, counts, grams))
        again = ~first
        yield _pack(REPEAT, _bucket(ids[again], buckets), buckets, {"docs": ids[again], "starts": starts[again], "counts": counts[again]})
        gram = np.cumsum(np.r_[0, grams[1:] != grams[:-1]])
        kinds = np.bincount(gram, weights=first)[gram]
        kinds[np.isin(grams, np.unique(np.concatenate(marks)))] = hot + 1
        for kind, some in ((ANCHOR, first & (kinds > 1) & (kinds <= hot)), (LOOSE, first & (kinds > hot))):
            yield _pack(kind, _bucket(grams[some], shards), shards, {"docs": ids[some], "starts": starts[some], "counts": counts[some]})

    return blocks.repartition(buckets, "bucket").mapInArrow(tidy(compare), _BLOCK)


def string_hashes(raw: np.ndarray, begin: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the strings of anchors, some anchors at a time: the two hashes of each, and the anchor it belongs to. Windows have at most
    ``2 * LENGTH`` bytes."""
    for k in range(0, len(begin), 1024):
        b, c = begin[k : k + 1024], count[k : k + 1024]
        width = int(c.max()) - 1 + LENGTH
        data = raw[np.minimum(b[:, None] + np.arange(width), len(raw) - 1)]
        up, down = (p.copy() for p in powers(width + 1))
        both = []
        for table in (BYTE_EXACT, _OTHER):
            sums = np.zeros((len(b), width + 1), np.uint64)
            np.cumsum(table[data] * up[:width], axis=1, out=sums[:, 1:])
            both.append(mix64((sums[:, LENGTH:] - sums[:, :-LENGTH]) * down[: width + 1 - LENGTH]))
        real = np.arange(width + 1 - LENGTH) < c[:, None]
        yield both[0][real], (both[1][real] >> np.uint64(32)).astype(np.uint32), np.nonzero(real)[0] + k


def combined_strings(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each string by document and start, and those that are later, in order."""
    strings = strings[np.lexsort((strings["start"], strings["doc"], strings["more"], strings["hash"]))]
    new = np.r_[True, (strings["hash"][1:] != strings["hash"][:-1]) | (strings["more"][1:] != strings["more"][:-1])][: len(strings)]
    of = np.maximum.accumulate(np.where(new, np.arange(len(strings)), 0))
    later = (strings["doc"] != strings["doc"][of]) | (strings["start"] != strings["start"][of])
    again = strings[later]
    return strings[new], again[np.lexsort((again["start"], again["doc"]))]


def packed_strings(strings: np.ndarray) -> bytes:
    """By document and start, which compress well then; hashes do not."""
    strings = strings[np.lexsort((strings["start"], strings["doc"]))]
    places = zlib.compress(np.diff(strings["doc"], prepend=0).tobytes() + strings["start"].tobytes(), 1)
    return len(strings).to_bytes(8, "little") + strings["hash"].tobytes() + strings["more"].tobytes() + places


def unpacked_strings(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    strings, places = np.zeros(n, _STRING), zlib.decompress(data[8 + 12 * n :])
    strings["hash"], strings["more"] = np.frombuffer(data, "<u8", n, 8), np.frombuffer(data, "<u4", n, 8 + 8 * n)
    strings["doc"], strings["start"] = np.cumsum(np.frombuffer(places, "<i8", n)), np.frombuffer(places, "<u4", n, 8 * n)
    return strings


def runs_of_starts(ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts one after the other as (document, first, count), of at most 255."""
    first = np.r_[True, (ids[1:] != ids[:-1]) | (begin[1:] != begin[:-1] + 1)][: len(ids)]
    nth = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    cut = np.flatnonzero(first | (nth % 255 == 0))
    return ids[cut], begin[cut], np.diff(np.r_[cut, len(ids)])


def shard_rows(compared: DataFrame, docs: DataFrame, shards: int) -> DataFrame:
    """(shard, key, start, count, bytes): what the suffixes of each shard are sorted in. Rows with STRINGS or RUNS for a count hold
    packed strings of hot k-grams, by hash, and runs of starts of those that the task knows to be repeats."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, shard, *told in zip(*(batch.column(n).to_pylist() for n in ("kind", "bucket", "docs", "starts", "counts")), strict=True):
                ids, starts, counts = (np.frombuffer(x, _KINDS[n]) for x, n in zip(told, ("docs", "starts", "counts"), strict=True))
                shard = np.full(len(ids), shard if kind == ANCHOR else -1, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ids), pa.array(starts.astype(np.int64)), pa.array(counts.astype(np.int32))], ["shard", "key", "start", "count"])

    asked = compared.where(F.col("kind") != REPEAT).select("kind", "bucket", "docs", "starts", "counts").mapInArrow(tidy(rows), "shard int, key long, start long, count int")
    asked = asked.groupBy("key").agg(F.collect_list(F.struct("shard", "start", "count")).alias("asked"))
    names = ["shard", "key", "start", "count", "bytes"]

    def packed_rows(values: np.ndarray, shard: np.ndarray, mark: int) -> pa.RecordBatch:
        order = np.argsort(shard, kind="stable")
        full, cuts = np.unique(shard[order], return_index=True)
        pack = packed_strings if mark == STRINGS else np.ndarray.tobytes
        data = [pack(values[order[a:b]]) for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
        zeros = pa.array(np.zeros(len(full), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), zeros, zeros, pa.array(np.full(len(full), mark, np.int32)), pa.array(data, pa.binary())], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            strings, again = combined_strings(np.concatenate(held))
            held.clear()
            yield packed_rows(strings, _bucket(strings["hash"], shards), STRINGS)
            ids, begin, count = runs_of_starts(again["doc"], again["start"].astype(np.int64))
            told = np.zeros(len(ids), _RUN)
            told["doc"], told["start"], told["count"] = ids, begin, count
            if len(told):
                yield packed_rows(told, _bucket(np.ascontiguousarray(told["doc"]), shards), RUNS)

        for batch in batches:
            lists = batch.column("asked")
            fields = lists.flatten()
            shard, start, count = (fields.field(n).to_numpy() for n in ("shard", "start", "count"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            raw, at = text_bytes(batch.column("text"))
            begin, data = at[row] + start, raw.tobytes()
            inside = begin + count - 1 + LENGTH <= at[row + 1]  # not so only for rows that repeat a doc_id with another text
            keys = batch.column("key").to_numpy()[row]
            whole, loose = inside & (shard >= 0), np.flatnonzero(inside & (shard < 0))
            pieces = [data[b:e] for b, e in zip(begin[whole].tolist(), (begin + count - 1 + LENGTH)[whole].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard[whole]), pa.array(keys[whole]), pa.array(start[whole]), pa.array(count[whole]), pa.array(pieces, pa.binary())], names)
            for hashes, more, of in string_hashes(raw, begin[loose], count[loose]):
                strings, anchor = np.zeros(len(of), _STRING), loose[of]
                nth = np.arange(len(of)) - np.maximum.accumulate(np.where(np.r_[True, of[1:] != of[:-1]], np.arange(len(of)), 0))
                strings["hash"], strings["more"], strings["doc"], strings["start"] = hashes, more, keys[anchor], start[anchor] + nth
                held.append(strings)
                if sum(map(len, held)) >= COMBINE:
                    yield from flush()
        if held:
            yield from flush()

    return docs.join(asked.hint("shuffle_hash"), "key").select("key", "text", "asked").mapInArrow(tidy(cut), "shard int, key long, start long, count int, bytes binary")


class Growing:
    """An array that grows at its end: in memory up to the room of a store, then in a file of it."""

    def __init__(self, kind: type, store: Store):
        self.kind, self.store, self.data, self.n = kind, store, store.array(0, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            was = self.data
            self.data = self.store.array(2 * (self.n + len(values)), self.kind)
            for k in range(0, self.n, 1 << 20):
                self.data[k : min(k + (1 << 20), self.n)] = was[k : min(k + (1 << 20), self.n)]
            self.store.release(was)
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)

    def whole(self) -> np.ndarray:
        return self.data[: self.n]


def repeated_starts(rows: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], budget: int = BUDGET, block: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """rows: (document, start, count, all bytes) of a shard's pieces, in order of document and start. Of all strings that
    start in the shard, those that start earlier too: blocks of (document, start)."""
    store = Store(budget // 2)
    text, keys, starts, counts = (Growing(t, store) for t in (np.uint8, np.int64, np.int64, np.int64))
    for doc, start, count, data in rows:
        # each piece is closed by a byte that is in no UTF-8 text
        size = count - 1 + LENGTH
        joined = np.full(len(data) + len(doc), 255, np.uint8)
        joined[np.arange(len(data)) + np.repeat(np.arange(len(doc)), size)] = data
        for column, values in zip((text, keys, starts, counts), (joined, doc, start, count), strict=True):
            column.add(values)
    text, keys, starts, counts = (x.whole() for x in (text, keys, starts, counts))

    def strings() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of strings: piece, number in it, place in the text."""
        end = 0
        for k in range(0, len(keys), block):
            count = np.asarray(counts[k : k + block])
            begin = end + np.cumsum(np.r_[0, count + LENGTH])[:-1]
            end += int((count + LENGTH).sum())
            piece = np.repeat(np.arange(len(count)), count)
            nth = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
            yield piece + k, nth, begin[piece] + nth

    starts_here, repeats = store.array(len(text), bool), store.array(len(text), bool)
    for _, _, at in strings():
        starts_here[at] = True
    open_min = -1  # the earliest start of the run that the blocks so far end in
    for pos, lcp in suffixes_descending(text, LENGTH, budget // 2):
        run = np.cumsum(lcp < LENGTH)
        mine = starts_here[pos]
        pos_in, run_in = pos[mine], run[mine]
        if run[-1] > 0 and (not len(run_in) or run_in[0] > 0):
            open_min = -1
        if not len(pos_in):
            continue
        cut = np.flatnonzero(np.r_[True, run_in[1:] != run_in[:-1]])
        least = np.minimum.reduceat(pos_in, cut)
        if run_in[0] == 0 and open_min >= 0:
            repeats[max(open_min, least[0])] = True
            least[0] = min(open_min, least[0])
        repeats[pos_in[pos_in != np.repeat(least, np.diff(np.r_[cut, len(pos_in)]))]] = True
        open_min = int(least[-1]) if run_in[-1] == run[-1] else -1
    for piece, nth, at in strings():
        found = np.flatnonzero(repeats[at])
        if len(found):
            yield keys[piece[found]], starts[piece[found]] + nth[found]


def fine_repeats(rows: DataFrame, buckets: int, shards: int) -> DataFrame:
    """REPEAT blocks by document of the strings that suffix sorting finds in the shards, and of equal strings of hot k-grams."""

    def block(ids: np.ndarray, begin: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return _pack(REPEAT, _bucket(np.ascontiguousarray(ids), buckets), buckets, {"docs": ids, "starts": begin, "counts": count})

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: list[np.ndarray] = []
        runs: list[np.ndarray] = []

        def pieces() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                count = batch.column("count").to_numpy()
                strings.extend(unpacked_strings(x) for x in batch.filter(pa.array(count == STRINGS)).column("bytes").to_pylist())
                runs.extend(np.frombuffer(x, _RUN) for x in batch.filter(pa.array(count == RUNS)).column("bytes").to_pylist())
                batch = batch.filter(pa.array(count > 0))
                if batch.num_rows:
                    key, start, count = (batch.column(n).to_numpy() for n in ("key", "start", "count"))
                    yield key, start, count.astype(np.int64), text_bytes(batch.column("bytes"))[0]

        for ids, begin in repeated_starts(pieces()):
            yield block(*runs_of_starts(ids, begin))
        for told in runs:
            yield block(told["doc"], told["start"], told["count"])
        if strings:
            again = combined_strings(np.concatenate(strings))[1]
            yield block(*runs_of_starts(again["doc"], again["start"].astype(np.int64)))

    return rows.repartition(shards, "shard").sortWithinPartitions("key", "start").mapInArrow(tidy(sort), _BLOCK)


def merged_spans(repeats: DataFrame, buckets: int) -> DataFrame:
    """(key, spans): maximal runs of removed bytes, as 32-bit pairs (start, end)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [columns for _, columns in _unpack(batches, ["docs", "starts", "counts"])]
        if not parts:
            return
        ids, starts, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((starts, ids))
        ids, begin = ids[order], starts[order].astype(np.int64)
        end = begin + counts[order] - 1 + LENGTH
        new = np.r_[True, ids[1:] != ids[:-1]]
        # ends so far within a document: documents are kept apart by an offset that grows with each
        apart = np.cumsum(new) * (1 << 33)
        reach = np.maximum.accumulate(end + apart)
        new |= np.r_[True, (begin + apart)[1:] > reach[:-1]]
        cut = np.flatnonzero(new)
        spans = np.stack([begin[cut], np.maximum.reduceat(end, cut)], axis=1).astype(np.uint32)
        doc = np.flatnonzero(np.r_[True, ids[cut][1:] != ids[cut][:-1]])
        ends = np.r_[doc[1:], len(cut)]
        for k in range(0, len(doc), 10_000):
            some = slice(k, k + 10_000)
            packed = [spans[a:b].tobytes() for a, b in zip(doc[some], ends[some], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[cut][doc[some]]), pa.array(packed, pa.binary())], ["key", "spans"])

    return repeats.select("kind", "bucket", "docs", "starts", "counts").repartition(buckets, "bucket").mapInArrow(tidy(merge), "key long, spans binary")


def suffix_dedup(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in bytes) and, if asked for, the kept
    bytes (which need not be whole characters)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    columns = [c for c in docs.columns if c not in results]
    slim = docs.select(document_key(F.col("doc_id")).alias("key"), "text")
    total = text_bytes_in(docs)
    buckets, shards = (partitions_for(spark, total, each) for each in (BUCKET_BYTES, SHARD_BYTES))
    compared = materialize(compared_anchors(anchor_blocks(slim, buckets), buckets, shards), "anchors")
    fine = fine_repeats(shard_rows(compared, slim, shards), buckets, shards)
    spans = merged_spans(compared.where(F.col("kind") == REPEAT).unionByName(fine), buckets)

    def apply(text: pa.Array, packed: pa.Array) -> pa.Array:
        raw, at = text_bytes(text)
        data = raw.tobytes()
        sizes, removed, n, digests, lists, kept = [], [], [], [], [], []
        for i, told in enumerate(packed.to_pylist()):
            own = data[at[i] : at[i + 1]]
            pairs = np.frombuffer(told, np.uint32).reshape(-1, 2).tolist() if told else []
            pairs = [[a, min(b, len(own))] for a, b in pairs if a < len(own)]
            parts, last = [], 0
            for a, b in pairs:
                parts.append(own[last:a])
                last = b
            left = b"".join([*parts, own[last:]]) if pairs else own
            sizes.append(len(own))
            removed.append(len(own) - len(left))
            n.append(len(pairs))
            digests.append(hashlib.sha256(left).hexdigest())
            lists.append([{"start": a, "end": b} for a, b in pairs])
            kept.append(left if with_kept else None)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        arrays = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(lists, kind), pa.array(kept, pa.binary())]
        return pa.StructArray.from_arrays(arrays, results)

    done = arrow_udf(apply, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept binary")
    keyed = docs.select(packed(columns), document_key(F.col("doc_id")).alias("key"), "text")
    out = keyed.join(spans.hint("shuffle_hash"), "key", "left").withColumn("done", done("text", "spans"))
    return out.select(*unpacked(columns), *[F.col(f"done.{r}").alias(r) for r in results if with_kept or r != "kept"])


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
