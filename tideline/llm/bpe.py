"""Byte-level BPE by a monoid tree reduction.

Encodings of byte strings form a monoid: the join of two is the encoding of both strings together. A match of the
splitting pattern is cut into halves, these again down to single bytes, and neighbours are joined up the tree. A join encodes a window around the boundary again, and widens it until the tokens outside are proven to
stay: a sequence of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs.
(The first merge that crossed a boundary between two such neighbours would be the lowest in rank, and the leftmost,
among the merges of these two alone as well, and so belong to the encoding of the two.) Inside each side all
neighbours are known to be so, inside the window too, and its two ends are looked at.

Decoding joins the tokens' bytes up a tree in the same way.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the longest string whose halves are kept: most halves of a word have been seen in other words.
HALF = 5
#: Strings and pairs of tokens, and matches, whose results are kept in a Python worker, and the longest of them.
KEPT, KEPT_MATCHES, LONGEST_STRING, LONGEST_MATCH = 1 << 18, 1 << 18, 24, 64
#: Characters of texts in one output batch; longer texts are split by the pattern piece by piece.
BATCH = 1 << 21


def fold(items: list, join: Callable, empty):
    """Join neighbours pair by pair, level by level."""
    while len(items) > 1:
        odd = items[-1:] if len(items) % 2 else []
        items = [join(a, b) for a, b in zip(items[::2], items[1::2])] + odd
    return items[0] if items else empty


class Vocabulary:
    """Ranks of tokens (base64 and number in each line of ``path``) and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self._kept: dict[bytes, list[int]] = {}
        self._halves: dict[bytes, list[int]] = {}
        self._pairs: dict[tuple[int, int], list[int] | None] = {}
        self._matches = _Matches(self)

    def merged(self, data: bytes) -> list[int]:
        """Plain encoding: the pair of the least rank, the leftmost of equal ones, is merged until none is left."""
        found = self._kept.get(data)
        if found is None:
            found = self._merge(data)
            if len(data) <= LONGEST_STRING:
                if len(self._kept) >= KEPT:
                    self._kept.clear()
                self._kept[data] = found
        return found

    def _merge(self, data: bytes) -> list[int]:
        ranks, n = self.ranks, len(data)
        end, before, gone = list(range(1, n + 1)), list(range(-1, n)), bytearray(n + 1)
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = end[i]
            if gone[i] or j == n or ranks.get(data[i : end[j]]) != rank:
                continue  # one of the two has been merged since
            end[i], gone[j] = end[j], 1
            before[end[i]] = i
            if end[i] < n and (r := ranks.get(data[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i))
            if i and (r := ranks.get(data[before[i] : end[i]])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [ranks[data[i : end[i]]] for i in range(n) if not gone[i]]

    def pair(self, a: int, b: int) -> list[int] | None:
        """Encoding of two tokens' bytes side by side; None if it is the two themselves."""
        found = self._pairs.get((a, b), self)
        if found is self:
            if len(self._pairs) >= KEPT:
                self._pairs.clear()
            found = self.merged(self.tokens[a] + self.tokens[b])
            found = self._pairs[a, b] = None if found == [a, b] else found
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of two encodings side by side."""
        if not left or not right:
            return left + right
        window = self.pair(left[-1], right[0])
        if window is None:
            return left + right
        a, b, pair = 1, 1, self.pair
        while True:
            more_left = a < len(left) and pair(left[-a - 1], window[0]) is not None
            more_right = b < len(right) and pair(window[-1], right[b]) is not None
            if not more_left and not more_right:
                return left[:-a] + window + right[b:]
            a, b = min(len(left), a * 2) if more_left else a, min(len(right), b * 2) if more_right else b
            window = self.merged(b"".join([self.tokens[t] for t in left[-a:] + right[:b]]))

    def halves(self, data: bytes) -> list[int]:
        """Encoding by halves, down to single bytes; those of short strings are kept."""
        found = self._halves.get(data)
        if found is None:
            n = len(data)
            found = self.join(self.halves(data[: n // 2]), self.halves(data[n // 2 :])) if n > 1 else [self.ranks[data]]
            if n <= HALF:
                if len(self._halves) >= KEPT:
                    self._halves.clear()
                self._halves[data] = found
        return found

    def encode_match(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern; a match that is a token is that token."""
        whole = self.ranks.get(data)
        return self.halves(data) if whole is None else [whole]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text: each match of the pattern on its own, without special tokens."""
        if len(text) <= BATCH:
            found = self.pattern.findall(text)
        else:
            found = (m.group() for m in self.pattern.finditer(text))
        return np.fromiter(chain.from_iterable(map(self._matches.__getitem__, found)), dtype=np.int32)

    def decode(self, ids: list[int]) -> bytes | None:
        """Bytes of the ids; None where one of them is no token."""
        token = self.tokens.__getitem__
        try:
            leaves = [b"".join(map(token, ids[at : at + 4096])) for at in range(0, len(ids), 4096)]
        except KeyError:
            return None
        return fold(leaves, bytes.__add__, b"")


class _Matches(dict):
    """Ids by match, as far as they are kept."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, match: str) -> list[int]:
        ids = self.vocabulary.encode_match(match.encode("utf-8"))
        if len(match) <= LONGEST_MATCH:
            if len(self) >= KEPT_MATCHES:
                self.clear()
            self[match] = ids
        return ids


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode(rows: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row, by the vocabulary file ``path``, which executors read.

    Defined results: a null or empty text has no ids; bytes that are no UTF-8 count as U+FFFD; rows with equal
    keys are encoded each; an empty table gives no rows; further columns are ignored; texts are never cut.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path, pattern)
        for batch in batches:
            keys, bodies = batch.column(0), batch.column(1)
            first, size, found = 0, 0, []
            for i in range(len(bodies)):
                body = bodies[i].as_py()
                found.append(voc.encode((body or b"").decode("utf-8", "replace")))
                size += len(body or b"")
                if size >= BATCH or i == len(bodies) - 1:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                    yield pa.RecordBatch.from_arrays([keys.slice(first, i + 1 - first), ids], names=[key, "ids"])
                    first, size, found = i + 1, 0, []

    return rows.select(key, F.col(text).cast("binary").alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` and ``decoded`` (binary) of every row.

    Defined results: no ids give no bytes; null ids, an id that is null or one that is no token give null.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path, pattern)
        for batch in batches:
            column, first, size, found = batch.column(1), 0, 0, []
            for i in range(len(column)):
                own = column[i].values
                found.append(None if own is None or own.null_count else voc.decode(own.to_numpy().tolist()))
                size += len(found[-1] or b"")
                if size >= BATCH or i == len(column) - 1:
                    some = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.binary())], names=[key, "ids", "decoded"])
                    first, size, found = i + 1, 0, []

    return rows.select(key, F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kinds[key]}, ids {kinds[ids]}, decoded binary")
