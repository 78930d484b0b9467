"""Transposition of 0-1 matrices whose rows are lines of text, in blocks of samples and sites with eight alleles a byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples and sites of a block (2 MB of bits; sites are a multiple of eight).
SAMPLES, SITES = 4096, 4096
#: Alleles that are turned round at once, or one block.
CELLS = 1 << 20


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``begin[i]``, ``begin[i] + 1``, ... (``n[i]`` of them), one after the other."""
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


def transposed(rows: DataFrame, keys: list[str], one_block: bool = False, samples: int = SAMPLES, sites: int = SITES) -> DataFrame:
    """``keys``, site and alleles (a string of the alleles of all samples in order) of rows (``keys``, sample, value: a string of 0
    and 1, one a site). Each line is cut and packed where it is read; lines of a block then lie
    together in order, and blocks are turned round one after the other. Blocks of samples are put
    together by site, unless there is ``one_block`` of them. Lines of unlike length, or of other characters, are an error."""
    types = dict(rows.dtypes)
    key_schema = "".join(f"`{k}` {types[k]}, " for k in keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All lines of a batch at once: each piece of a line starts at a whole byte."""
        for batch in batches:
            if not batch.num_rows:
                continue
            value = batch.column("value").cast(pa.large_string())
            at = np.frombuffer(value.buffers()[1], np.int64, len(value) + 1, value.offset * 8)
            alleles = np.frombuffer(value.buffers()[2], np.uint8)[at[0] : at[-1]] - np.uint8(ord("0"))
            size, at = np.diff(at), at[:-1] - at[0]
            if (alleles > 1).any():
                line = int(np.searchsorted(at, np.argmax(alleles > 1), side="right")) - 1
                raise ValueError(f"an allele other than 0 and 1 in {value[line].as_py()[:50]}")
            pieces = -(-size // sites)
            row = np.repeat(np.arange(len(size)), pieces)
            block = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            width = np.minimum(sites, size[row] - block * sites)
            ends = np.cumsum(-(-width // 8))
            begins = np.r_[0, ends[:-1]]
            bits = np.zeros(8 * int(ends[-1]) if len(ends) else 0, np.uint8)
            bits[_ranges(8 * begins, width)] = alleles[_ranges(at[row] + block * sites, width)]
            packed = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(np.packbits(bits))])
            some = batch.select([*keys, "sample"]).take(pa.array(row))
            columns = [*some.columns, pa.array(block.astype(np.int32)), pa.array(size[row].astype(np.int32)), packed.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "sample", "site_block", "total", "bits"])

    def turned(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        """(``keys``, block of samples, site, alleles) of whole blocks, which begin at rows ``cuts``, the last one ending at the last."""
        table = table.combine_chunks()
        total, of = table.column("total").to_numpy(), np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        if (total != total[cuts[:-1]][of]).any():
            raise ValueError("samples with unlike numbers of sites")
        lines, first = np.diff(cuts), table.column("site_block").to_numpy()[cuts[:-1]].astype(np.int64) * sites
        width = np.minimum(sites, total[cuts[:-1]] - first)
        packed = table.column("bits").cast(pa.large_binary()).combine_chunks()
        bytes_at = np.frombuffer(packed.buffers()[1], np.int64, len(packed) + 1, packed.offset * 8)
        bits = np.unpackbits(np.frombuffer(packed.buffers()[2], np.uint8)[bytes_at[0] : bytes_at[-1]])
        stride = 8 * -(-width // 8)
        begin = 8 * (bytes_at[cuts[:-1]] - bytes_at[0])
        block = np.repeat(np.arange(len(width)), width)  # of each line that comes out
        site = _ranges(np.zeros(len(width), np.int64), width)
        n = lines[block]
        if len(cuts) == 2:  # one large block: no index of its cells
            text = np.ascontiguousarray(bits.reshape(lines[0], -1)[:, : width[0]].T).ravel()
        else:
            text = bits[np.repeat(begin[block] + site, n) + _ranges(np.zeros(len(n), np.int64), n) * np.repeat(stride[block], n)]
        alleles = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(np.r_[0, np.cumsum(n)].astype(np.int64)), pa.py_buffer(text + np.uint8(ord("0")))])
        rows = pa.array(cuts[:-1][block])
        some = [table.column(c).combine_chunks().take(rows) for c in (*keys, "sample_block")]
        return pa.RecordBatch.from_arrays([*some, pa.array((first[block] + site).astype(np.int32)), alleles.cast(pa.string())], names=[*keys, "sample_block", "site", "alleles"])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of whole blocks of about ``CELLS`` alleles; lines of a block that goes on in the next batch wait for it."""
        held: list[pa.RecordBatch] = []

        def starts(table: pa.Table) -> np.ndarray:
            new = np.zeros(max(table.num_rows - 1, 0), bool)
            for c in (*keys, "site_block", "sample_block"):
                x = table.column(c).combine_chunks()
                new |= ~pc.fill_null(pc.equal(x[1:], x[:-1]), False).to_numpy(zero_copy_only=False) & ~pc.and_(pc.is_null(x[1:]), pc.is_null(x[:-1])).to_numpy(zero_copy_only=False)
            return np.r_[0, np.flatnonzero(new) + 1]

        def runs(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            cells = np.cumsum(8 * pc.binary_length(table.column("bits")).to_numpy().astype(np.int64))[cuts[1:] - 1]
            a = 0
            while a < len(cuts) - 1:
                b = max(int(np.searchsorted(cells, (cells[a - 1] if a else 0) + CELLS, side="right")), a + 1)
                yield turned(table.slice(cuts[a], cuts[b] - cuts[a]), cuts[a : b + 1] - cuts[a])
                a = b

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and len(starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch]))) == 1:
                held.append(batch)  # one block still
                continue
            table = pa.Table.from_batches([*held, batch])
            cuts = starts(table)
            yield from runs(table, cuts)
            held = table.slice(cuts[-1]).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from runs(table, np.r_[starts(table), table.num_rows])

    packed = rows.select(*keys, F.col("sample").cast("long").alias("sample"), "value").where("value <> ''").mapInArrow(pack, f"{key_schema}sample long, site_block int, total int, bits binary")
    block = [*keys, "site_block", "sample_block"]
    dealt = packed.withColumn("sample_block", F.floor(F.col("sample") / samples)).repartition(*block).sortWithinPartitions(*block, "sample")
    parts = dealt.mapInArrow(turn, f"{key_schema}sample_block long, site int, alleles string")
    if one_block:
        return parts.select(*keys, "site", "alleles")
    told = parts.groupBy(*keys, "site").agg(F.array_sort(F.collect_list(F.struct("sample_block", "alleles"))).alias("_a"))  # a row a block of samples
    return told.select(*keys, "site", F.array_join(F.transform("_a", lambda p: p["alleles"]), "").alias("alleles"))
