"""Vectorised views of Arrow text columns: word hashes, n-grams and runs, without a Python loop over words."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text handled at once; a longer text is handled whole, alone.
BLOCK_BYTES = 1 << 18

_M = 0x9E3779B97F4A7C15
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives the memory that it no longer uses back to the system. A worker outlives its task, and others run beside it."""

    def then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return then_release


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library may be another
        if trim is not None:
            trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        m = np.full(n, _M, dtype=np.uint64)
        m[0] = 1
        _powers = np.multiply.accumulate(m)
        m[1:] = pow(_M, -1, 1 << 64)
        _inverse = np.multiply.accumulate(m)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def blocks(col: pa.Array, lower: bool = False, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, offsets, bytes) for runs of rows of about ``size`` bytes."""
    offsets, raw = flat(pc.utf8_lower(col) if lower else col)
    first = 0
    while first < len(offsets) - 1:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        end = min(end, first + 60_000)
        yield first, end, offsets[first : end + 1] - offsets[first], raw[offsets[first] : offsets[end]]
        first = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of True that stay within one row."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each word of lower-cased text: runs of ASCII letters and digits and of non-ASCII characters.

    A polynomial hash modulo 2**64, from prefix sums, then mixed.
    """
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end, row = runs(_WORD[raw], offsets)
    _grow(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * _inverse[start] + np.uint64(1)), row, start, end


def word_hash(word: str) -> int:
    """The hash of one lower-cased word, as ``word_hashes`` makes it."""
    total, power = 0, 1
    for b in word.encode():
        total = (total + (b + 1) * power) & 0xFFFFFFFFFFFFFFFF
        power = power * _M & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([(total + 1) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])
