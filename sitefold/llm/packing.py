"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token ids and an end id; only those longer than a sequence are cut. How pieces share sequences depends
on their lengths alone, so the plan is made from a histogram of lengths: at most ``capacity`` counters, whatever the size
of the corpus. The reduction fixes a piece together with at most two others wherever that set dominates every other set
the piece could be in (so some optimal packing contains it), for as many copies as the histogram has; best-fit decreasing
packs what is left, also for all copies at once. The plan says which ranks of each length go to which sequences at which
offset; a salted, distributed ranking of the pieces of each length then reads its place off the plan.

Defined results: a null or empty text is the end id alone; a null doc_id is kept; repeated rows are packed each on their
own; equal lengths are ranked by a hash and doc_id, so reruns agree; an empty table gives an empty result; other columns
are not carried.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import bounded_batches, materialize, read_table
from ._tokens import tokenizer
from ._words import tidy

#: Production parameters.
TOKENIZER, END_ID, CAPACITY, SALTS = "word_bpe_49k.json", 1, 4096, 256


def token_pieces(docs: DataFrame, name: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    bounded_batches(docs.sparkSession)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, end = tokenizer(name), end_id.to_bytes(4, "little")
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                told = chunks.ids(text or "") + end
                for k, at in enumerate(range(0, len(told), 4 * capacity)):
                    part = told[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=[f.split(" ")[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(tidy(pieces), schema)


class Stock:
    """How many pieces of each length are left, in order of length."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.count)

    def take(self, sizes: Counter, times: int) -> None:
        for s, n in sizes.items():
            self.count[s] -= n * times
            if not self.count[s]:
                del self.count[s]
                del self.lengths[bisect_left(self.lengths, s)]

    def left(self, size: int, used: Counter) -> int:
        return self.count.get(size, 0) - used[size]

    def largest(self, at_most: int, used: Counter) -> int | None:
        for i in range(bisect_right(self.lengths, at_most) - 1, -1, -1):
            if self.left(self.lengths[i], used) > 0:
                return self.lengths[i]
        return None

    def smallest(self, n: int, used: Counter, above: int = 0) -> list[int]:
        """The ``n`` smallest pieces longer than ``above``; fewer if there are not so many."""
        out: list[int] = []
        for i in range(bisect_right(self.lengths, above), len(self.lengths)):
            out += [self.lengths[i]] * min(n - len(out), self.left(self.lengths[i], used))
            if len(out) == n:
                break
        return out


def dominating_set(stock: Stock, j: int, capacity: int) -> Counter | None:
    """The set with a piece of length ``j`` and at most two more that dominates all its feasible sets, if there is one."""
    one, gap = Counter([j]), capacity - j
    a = stock.largest(gap, one)
    if a is None:
        return one
    few = stock.smallest(3, one)
    if a == gap or len(few) < 2 or few[0] + few[1] > gap:
        return Counter([j, a])
    if len(few) < 3 or sum(few) > gap:
        b = stock.largest(gap - a, Counter([j, a]))
        if b is None:
            return None
        over = stock.smallest(2, one, above=b)
        if len(over) < 2 or sum(over) > gap:  # then no feasible pair has a smaller part above b, nor a larger part above a
            return Counter([j, a, b])
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Counter, int]], dict[int, int]]:
    """Sets that are fixed for good, with how many times each; and the counts that are left."""
    stock, fixed = Stock(counts), []
    for j in sorted(counts, reverse=True):
        while stock.count.get(j, 0) and (sizes := dominating_set(stock, j, capacity)):
            times = min(stock.count[s] // n for s, n in sizes.items())
            stock.take(sizes, times)
            fixed.append((sizes, times))
    return fixed, stock.count


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, how many, first sequence, offset) and the number of sequences."""
    plan: list[tuple[int, int, int, int, int]] = []
    ranks: Counter = Counter()
    sequences = 0

    def place(length: int, times: int, sequence: int, offset: int) -> None:
        plan.append((length, ranks[length], times, sequence, offset))
        ranks[length] += times

    fixed, left = reduce_by_dominance(counts, capacity)
    for sizes, times in fixed:
        offset = 0
        for s in sorted(sizes.elements(), reverse=True):
            place(s, times, sequences, offset)
            offset += s
        sequences += times

    gaps: list[int] = []  # sorted gaps of open sequences; open_at: runs (first sequence, how many) with such a gap
    open_at: dict[int, list[tuple[int, int]]] = {}

    def reopen(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_at:
                open_at[gap] = []
                insort(gaps, gap)
            open_at[gap].append((first, n))

    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            i = bisect_left(gaps, length)
            if i < len(gaps):
                gap = gaps[i]
                first, n = open_at[gap].pop()
                if not open_at[gap]:
                    del open_at[gap], gaps[i]
            else:
                gap, first = capacity, sequences
                n = -(-todo // (capacity // length))
                sequences += n
            # best fit keeps to the sequence it began until the length does not fit any more
            each = gap // length
            full = min(n, todo // each)
            for k in range(each if full else 0):
                place(length, full, first, capacity - gap + k * length)
            todo -= full * each
            reopen(gap - each * length, first, full)
            if full < n:
                some = min(todo, each)
                for k in range(some):
                    place(length, 1, first + full, capacity - gap + k * length)
                todo -= some
                reopen(gap - some * length, first + full, 1 if some else 0)
                rest = first + full + (1 if some else 0)
                reopen(gap, rest, first + n - rest)
    return np.array(sorted(plan), np.int64).reshape(-1, 5), sequences


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """``pieces`` (see :func:`token_pieces`) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    plan = spark.sparkContext.broadcast(packing_plan(counts, capacity)[0])  # bounded by capacity, not by the corpus

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt")
    offsets = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).select("length", "_salt", (F.sum("n").over(before) - F.col("n")).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["length", "_salt"])

    def look_up(length: pa.Array, rank: pa.Array) -> pa.Array:
        rows = plan.value
        key = (rows[:, 0] << 44) + rows[:, 1]
        n = rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(key, (length.to_numpy(zero_copy_only=False) << 44) + n, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(rows[at, 3] + n - rows[at, 1]), pa.array(rows[at, 4])], ["sequence_id", "offset"])

    from pyspark.sql.functions import arrow_udf

    put = arrow_udf(look_up, "sequence_id long, offset long")
    placed = ranked.withColumn("_at", put("length", F.col("_before") + F.col("_rank")))
    return placed.select(*[c for c in pieces.columns if c not in ("sequence_id", "offset")], "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, name: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All documents packed into sequences of at most ``capacity`` tokens."""
    return pack_pieces(materialize(token_pieces(docs, name, end_id, capacity, with_ids), "pieces"), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
