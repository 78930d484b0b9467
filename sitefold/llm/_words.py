"""Vectorised word hashing over Arrow string columns (numpy, inside tasks).

Words are runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``, hashed with A-Z lower-cased; a whole batch is hashed
without building one Python string. Windows of bytes have 64-bit polynomial prefix hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BYTE_EXACT = _BYTE
#: Pieces of a word that are hashed for all words at once; masks of the first bytes of a piece; a step between pieces.
_ROUNDS = 8
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP = np.uint64(0x9FB21C651E98DF25)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` for a task: when it ends, memory that was freed goes back to the system, as several reused workers share an
    executor's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            for k in (0, 1):
                _powers[k] = np.ones(1, np.uint64)
            pa.default_memory_pool().release_unused()
            getattr(ctypes.CDLL(None), "malloc_trim", int)(0)

    return run


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64; kept for the next call."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INV)):
            out = np.ones(size, np.uint64)
            filled, step = 1, base
            while filled < size:
                out[filled : 2 * filled] = out[:filled] * np.uint64(step)
                filled, step = 2 * filled, step * step % (1 << 64)
            _powers[k] = out
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """``values[j] * base**j`` summed before each position; one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    if len(values):
        np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]``, the same wherever the range lies."""
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts and the last ends; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and where each row's words begin in these lists (one more at the end)."""
    word = ~_SPACE[raw]
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = word
    before[at] = False
    after = np.zeros(len(raw) + 1, bool)
    after[:-1] = word
    after[at] = False
    starts = np.flatnonzero(word & ~before[:-1])
    ends = np.flatnonzero(word & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word: a sum over its 8-byte pieces, each scrambled together with its place. (A
    polynomial modulo 2**64 would give words of a thousand regularly alternating letters one hash at any base.)"""
    low = np.zeros(len(raw) + 8, np.uint8)
    low[: len(raw)] = _LOWER[raw]
    pieces = np.lib.stride_tricks.as_strided(low[:8].view(np.uint64), (len(raw) + 1,), (1,))
    size = ends - starts
    out = size.astype(np.uint64)
    long = np.flatnonzero(size > 8 * _ROUNDS)
    row = np.arange(len(starts))
    for k in range(_ROUNDS):
        row = row[size[row] > 8 * k]
        if not len(row):
            break
        out[row] += mix64((pieces[starts[row] + 8 * k] & _KEEP[np.minimum(size[row] - 8 * k, 8)]) + np.uint64(int(_STEP) * (k + 1) % (1 << 64)))
    for i in long.tolist():  # what is left of the few long words, each at once
        at = np.arange(starts[i] + 8 * _ROUNDS, ends[i], 8)
        keep = _KEEP[np.minimum(ends[i] - at, 8)]
        out[i] += mix64((pieces[at] & keep) + _STEP * np.arange(_ROUNDS + 1, _ROUNDS + 1 + len(at), dtype=np.uint64)).sum()
    return mix64(out)
