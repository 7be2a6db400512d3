"""Vectorised byte work on Arrow text columns: buffers, rolling hashes, words and shingles.

A text column of an Arrow batch is one buffer of UTF-8 bytes with offsets, so numpy reads whole
texts without building Python strings. ``pieces`` bounds memory: it cuts a batch between rows, so
only a single text longer than the bound is ever handled in one piece of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19
_RNG = np.random.default_rng(20240611)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(2**62, 2**63)) * 2 + 1
_MASK = (1 << 64) - 1


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets of the texts (null = empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8).copy()
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) whose texts hold at most ``limit`` bytes (a longer single row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, handing freed memory back when a task's rows end: Spark keeps its Python workers,
    and what an idle one holds on to counts against the executor's memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
            if trim is not None:
                trim(0)

    return whole


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a polynomial hash so that every bit depends on every input byte."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of every ``length`` bytes in a row; shorter input gives none."""
    if len(raw) < length:
        return np.zeros(0, np.uint64)
    power, width, done, out = BYTE_CODE[raw], 1, 0, None
    rest = length
    while rest:
        if rest & 1:
            if out is None:
                out = power
            else:
                n = min(len(out), len(power) - done)
                shift = np.uint64(pow(BASE, width, 1 << 64))
                out = out[:n] * shift + power[done : done + n]
            done += width
        rest >>= 1
        if rest:
            shift = np.uint64(pow(BASE, width, 1 << 64))
            power = power[:-width] * shift + power[width:]
            width *= 2
    return out[: len(raw) - length + 1]


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Prefix:
    """Hashes of arbitrary ranges of a buffer, from one running sum (mod 2^64)."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes) + 1
        self._powers, self._inverse = Prefix._powers, Prefix._inverse
        if len(self._powers) < n:
            size = 1 << int(n - 1).bit_length()
            self._powers = self._table(BASE, size)
            self._inverse = self._table(pow(BASE, -1, 1 << 64), size)
            if size <= 2 * PIECE_BYTES:  # the tables of one very long text go with it
                Prefix._powers, Prefix._inverse = self._powers, self._inverse
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(codes * self._powers[: n - 1], out=self.sums[1:])

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < size:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        return out

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self._inverse[start]
        return mix(h + np.uint64(0x632BE59BD9B4E019) * (end - start).astype(np.uint64))
