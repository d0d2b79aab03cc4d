"""Shingle sets and min-max hash signatures of whole Arrow batches."""

from __future__ import annotations

import numpy as np

from . import rolling



def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and the offsets of the rows in them.

    Words are lower-cased in A-Z. A row with fewer than ``size`` words has its whole sequence as its one
    shingle; a row without words has none.
    """
    words = rolling.Words(data, offsets, lower=True)
    sums = rolling.prefix_sums(words.hash)
    n = np.diff(words.bounds)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    start = words.bounds[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    end = np.minimum(start + size, words.bounds[1:][row])
    hashes = rolling.substring_hashes(sums, start, end)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(n) + 1))


def set_keys(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each row's set; equal sets have equal keys."""
    keys = []
    for salt in (np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)):
        total = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(rolling.mix64(hashes ^ salt), out=total[1:])
        keys.append(total[at[1:]] - total[at[:-1]])
    return keys[0], keys[1]


def min_max(hashes: np.ndarray, at: np.ndarray, permutations: int) -> np.ndarray:
    """Signature of each row that has shingles: minimum and maximum under every permutation.

    One evaluation of a permutation gives two values, each of which agrees for two sets with the
    probability of their Jaccard similarity.
    """
    rng = np.random.Generator(np.random.PCG64(11))
    factor = rng.integers(0, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**64, permutations, dtype=np.uint64)
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), 2 * permutations), dtype=np.uint64)
    for k in range(permutations):
        values = hashes * factor[k] + shift[k]
        if len(starts):
            out[:, 2 * k] = np.minimum.reduceat(values, starts)
            out[:, 2 * k + 1] = np.maximum.reduceat(values, starts)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` signature values, for each row of ``signature``.

    A band takes values of different permutations: minima and maxima are dealt to different bands.
    """
    minima, maxima = signature[:, 0::2], signature[:, 1::2]
    dealt = np.concatenate([minima, maxima], axis=1)
    bands = dealt.shape[1] // rows
    keys = np.zeros((len(dealt), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(dealt), b + 1, dtype=np.uint64)
        for v in range(b * rows, (b + 1) * rows):
            key = rolling.mix64(key * np.uint64(0x9E3779B97F4A7C15) + dealt[:, v])
        keys[:, b] = key
    return keys
