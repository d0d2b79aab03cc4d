"""Rolling 64-bit hashes of byte strings, words and word windows over whole Arrow batches.

A text's bytes are mapped to random 64-bit numbers and summed with powers of an odd base, so that the
hash of any substring is a difference of two prefix sums, times a power of the base's inverse. All work
is on numpy arrays that cover many documents at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 2**63, dtype=np.uint64)) * 8 + 5
_BASE &= 2**64 - 1
_INVERSE = pow(_BASE, -1, 2**64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are hashed at a time: the arrays of a step take some 60 times as much.
CHUNK = 1 << 19


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    size = 1 << max(CHUNK.bit_length(), int(n).bit_length())
    return _powers(_INVERSE if inverse else _BASE, size)[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of bytes, or of 64-bit symbols, times the powers of the base."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum((_TABLE[data] if data.dtype == np.uint8 else data) * powers(len(data)), out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end) of the data that ``sums`` was made from."""
    raw = (sums[end] - sums[start]) * powers(len(sums), inverse=True)[start]
    return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of ``size`` symbols, as :func:`substring_hashes` gives them, without lookups."""
    n = max(len(sums) - size, 0)
    raw = sums[size:] - sums[:n]
    raw *= powers(n, inverse=True)
    raw += np.uint64(size * 0x9E3779B97F4A7C15 % 2**64)
    return mix64(raw)


def texts(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    array = batch.column(column)
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    if array.buffers()[2] is None or not len(array):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(array) + 1, dtype=np.int64)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: int, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of ``batch`` with about ``size`` bytes of text each (one row at least), bytes and offsets."""
    data, offsets = texts(batch, column)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """Words of a chunk: their byte bounds, hashes, and the range of words of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        inside = np.empty(len(data) + 2, dtype=bool)
        inside[0] = inside[-1] = False
        np.logical_not(_IS_SPACE[data], out=inside[1:-1])
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True
        starts = inside[1:-1] & (~inside[:-2] | first[:-1])
        ends = inside[1:-1] & (~inside[2:] | first[1:])
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.hash = substring_hashes(prefix_sums(_LOWER[data] if lower else data), self.start, self.end)
        #: words of row i are bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on; those that would leave the chunk are missing."""
        return gram_hashes(prefix_sums(self.hash), n)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` consecutive values, the leftmost of equal ones.

    Values are compared by their upper 40 bits. Long inputs are cut into overlapping parts.
    """
    n, part = len(values) - width + 1, 1 << 23
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    if n > part:
        return np.concatenate([at + sliding_argmin(values[at : at + part + width - 1], width) for at in range(0, n, part)])
    low = np.uint64((1 << 24) - 1)
    keys = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    pad = -len(keys) % width
    blocks = np.concatenate([keys, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[:n], forward[width - 1 : width - 1 + n])
    return (least & low).astype(np.int64)
