"""Windows of a fixed length that also start earlier in the corpus, found without moving all of them.

A window is ``size`` consecutive symbols (bytes or words) of one document. Each window has an anchor,
the gram of ``gram`` symbols with the least hash in it; equal windows have equal anchors, so a window
can only be repeated if its anchor is. Consecutive windows with one anchor form a block. The search
goes digit by digit, from the coarsest to the finest, as most-significant-digit radix passes do, and
each pass moves only what the one before left undecided:

1. anchors: those found in one document only decide all their windows at once;
2. blocks: a block whose whole text also stands in an earlier document repeats with all its windows;
3. parts of blocks (``parts`` windows each, where given), for blocks that differ but share an anchor;
4. single windows, where parts differ.

Documents are compared by id. What a pass says about a document is a set of 64-bit keys, at most as
many as the document has windows. Within a chunk of documents a task decides alone what it can (the
chunk's earliest copy stands for the others), so a passage that a third of all documents share brings
one row for each chunk to its key's task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rolling

NO_ID = 2**63 - 1
ROWS = "g bigint, c bigint, id bigint, sure boolean"


@dataclass(frozen=True)
class Spec:
    """``unit``: bytes or words; ``parts``: windows in a part of a block, 0 to go from blocks to windows."""

    unit: str
    size: int
    gram: int
    parts: int = 0


class Blocks:
    """Blocks of one chunk of documents: windows first to last (exclusive), anchor place and hash, row."""

    def __init__(self, spec: Spec, data: np.ndarray, offsets: np.ndarray):
        self.spec = spec
        if spec.unit == "words":
            self.words = rolling.Words(data, offsets)
            symbols, self.bounds = self.words.hash, self.words.bounds
        else:
            symbols, self.bounds = data, offsets
        self.sums = rolling.prefix_sums(symbols)
        grams = rolling.gram_hashes(self.sums, spec.gram)
        anchor = rolling.sliding_argmin(grams, spec.size - spec.gram + 1)
        row = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        inside = row[: len(anchor)] == row[spec.size - 1 :][: len(anchor)]
        new = np.ones(len(anchor), dtype=bool)
        if len(anchor):
            new[1:] = (anchor[1:] != anchor[:-1]) | (row[1 : len(anchor)] != row[: len(anchor) - 1]) | ~inside[:-1]
        self.first = np.flatnonzero(new & inside)
        edge = np.append(np.flatnonzero(new | ~inside), len(anchor))
        self.last = edge[np.searchsorted(edge, self.first, "right")]
        self.anchor = anchor[self.first]
        self.hash = grams[self.anchor]
        self.row = row[self.first]

    def keys(self, some: np.ndarray) -> np.ndarray:
        """Key of each whole block: its text and its anchor."""
        text = rolling.substring_hashes(self.sums, self.first[some], self.last[some] - 1 + self.spec.size)
        return rolling.mix64(text ^ (self.hash[some] >> np.uint64(7)))

    def split(self, some: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        """Parts of the blocks ``some``: their block, first and last window, group and key.

        A part's windows start at like distances from the anchor, so equal texts are cut alike.
        """
        first, last, anchor = self.first[some], self.last[some], self.anchor[some]
        if width == 1:
            n = last - first
        else:
            low = (first - anchor) // width
            n = (last - 1 - anchor) // width - low + 1
        block = np.repeat(np.arange(len(first)), n)
        k = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
        if width == 1:
            a = first[block] + k
            b, group = a + 1, self.hash[some][block]
        else:
            step = low[block] + k
            a = np.maximum(anchor[block] + step * width, first[block])
            b = np.minimum(anchor[block] + (step + 1) * width, last[block])
            group = rolling.mix64(self.hash[some][block] + (step + (1 << 20)).astype(np.uint64))
        text = rolling.substring_hashes(self.sums, a, b - 1 + self.spec.size)
        salt = np.uint64(0x632BE59BD9B4E019 if width == 1 else 0x9E6C63D0876A9A47)
        return some[block], a, b, group, rolling.mix64(text ^ (self.hash[some][block] >> np.uint64(9)) ^ salt)


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _anchors_of(g: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """One row for each anchor and id; where ids of a chunk share an anchor, both are sure of it."""
    order = np.lexsort((ids, g))
    g, ids = g[order], ids[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (ids[1:] != ids[:-1])
    g, ids = g[new], ids[new]
    head = np.ones(len(g), dtype=bool)
    head[1:] = g[1:] != g[:-1]
    shared = ~head
    shared[:-1] |= ~head[1:]
    return _rows(g, g, ids, head, shared)


def _rows(g: np.ndarray, c: np.ndarray, ids: np.ndarray, head: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
    alone = rolling.mix64(c[sure] ^ rolling.mix64(ids[sure].astype(np.uint64)))
    return _batch(
        ["g", "c", "id", "sure"],
        np.concatenate([_long(g[head]), _long(alone)]),
        np.concatenate([_long(c[head]), _long(c[sure])]),
        np.concatenate([ids[head], ids[sure]]),
        np.concatenate([np.zeros(head.sum(), dtype=bool), np.ones(sure.sum(), dtype=bool)]),
    )


def _texts_of(g: np.ndarray, c: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """One row for each group, key and id; all but the least id of a chunk are sure to repeat."""
    order = np.lexsort((ids, c, g))
    g, c, ids = g[order], c[order], ids[order]
    head = np.ones(len(g), dtype=bool)
    head[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    new = np.ones(len(g), dtype=bool)
    new[1:] = head[1:] | (ids[1:] != ids[:-1])
    return _rows(g, c, ids, head, new & ~head)


def _listed(batch: pa.RecordBatch, column: str = "keys") -> tuple[np.ndarray, np.ndarray]:
    """Values of an array column and the row of each."""
    array = batch.column(column)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1]
    if array.null_count:
        sizes = np.where(array.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    else:
        sizes = np.diff(offsets)
    values = array.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
    return values, np.repeat(np.arange(len(array)), sizes)


def _having(key: np.ndarray, row: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which (row, key) are among (rows, values)."""
    if not len(values) or not len(key):
        return np.zeros(len(key), dtype=bool)
    mark = lambda k, r: rolling.mix64(k + r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    known = np.sort(mark(values, rows))
    wanted = mark(key, row)
    at = np.searchsorted(known, wanted)
    at[at == len(known)] = 0
    return known[at] == wanted


def _chunked(spec: Spec, rows: Callable[[Blocks, pa.RecordBatch, np.ndarray], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, data, offsets in rolling.chunks(batch, 1):
                yield rows(Blocks(spec, data, offsets), some, some.column(0).to_numpy())

    return run


def _decide(rows: DataFrame) -> DataFrame:
    """Rows with ``repeated`` (the key has an earlier document) and ``split`` (the group has other keys)."""
    same, group = W.partitionBy("g", "c"), W.partitionBy("g")
    # dealt by group here, so that both readers of the result share one exchange
    return rows.repartition("g").select(
        "g",
        "c",
        "id",
        (F.col("sure") | (F.min("id").over(same) < F.col("id"))).alias("repeated"),
        (F.min("c").over(group) < F.max("c").over(group)).alias("split"),
    )


def _per_document(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.collect_set("key").alias("keys"))


def repeated_keys(docs: DataFrame, spec: Spec) -> DataFrame:
    """``docs`` (id, text, any others) with ``keys``: what :func:`covered` needs to find repeated windows.

    ``id`` must be an expression that cannot be null. Every pass joins the same columns of ``docs``, so that
    Spark moves the texts once and reads that exchange again.
    """
    columns = docs.columns
    found = docs.mapInArrow(_chunked(spec, lambda b, some, ids: _anchors_of(b.hash, ids[b.row])), ROWS)
    group = W.partitionBy("g")
    shared = found.withColumn("many", F.min("id").over(group) < F.max("id").over(group)).where("sure or many")
    todo = _per_document(shared.select("id", F.col("c").alias("key")))

    def blocks(b: Blocks, some: pa.RecordBatch, ids: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(_having(b.hash, b.row, *_listed(some)))
        return _texts_of(b.hash[at], b.keys(at), ids[b.row[at]])

    def finer(width: int, before: int):
        def rows(b: Blocks, some: pa.RecordBatch, ids: np.ndarray) -> pa.RecordBatch:
            listed = _listed(some)
            at = np.arange(len(b.first))
            at = at[_having(b.hash, b.row, *listed)]
            if not before:
                at = at[_having(b.keys(at), b.row[at], *listed)]
                block, _, _, group, key = b.split(at, width)
            else:
                block, first, last, _, key = b.split(at, before)
                part = _having(key, b.row[block], *listed)
                inner = object.__new__(Blocks)
                inner.spec, inner.sums = b.spec, b.sums
                inner.first, inner.last = first[part], last[part]
                inner.anchor, inner.hash, inner.row = b.anchor[block[part]], b.hash[block[part]], b.row[block[part]]
                block, _, _, group, key = inner.split(np.arange(part.sum()), width)
                return _texts_of(group, key, ids[inner.row[block]])
            return _texts_of(group, key, ids[b.row[block]])

        return rows

    def next_pass(todo: DataFrame, rows) -> DataFrame:
        joined = docs.join(todo, "id").select(*columns, "keys")
        return _decide(joined.mapInArrow(_chunked(spec, rows), ROWS))

    def undecided(decided: DataFrame, anchors: bool) -> DataFrame:
        left = decided.where("not repeated and split")
        keys = F.array("g", "c") if anchors else F.array("c")
        return left.select("id", F.explode(keys).alias("key"))

    decided = next_pass(todo, blocks)
    hits = [decided.where("repeated").select("id", F.col("c").alias("key"))]
    todo = undecided(decided, anchors=True)
    todo_anchors = todo
    if spec.parts:
        decided = next_pass(_per_document(todo), finer(spec.parts, 0))
        hits.append(decided.where("repeated").select("id", F.col("c").alias("key")))
        # anchors stay in the list: only blocks with an undecided anchor are split again
        todo = undecided(decided, anchors=False).unionByName(todo_anchors)
    decided = next_pass(_per_document(todo), finer(1, spec.parts))
    hits.append(decided.where("repeated").select("id", F.col("c").alias("key")))
    keys = hits[0]
    for more in hits[1:]:
        keys = keys.unionByName(more)
    return docs.join(_per_document(keys), "id", "left").select(*columns, "keys")


def covered(spec: Spec, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, rows: np.ndarray, inside: bool) -> tuple[Blocks, np.ndarray]:
    """Which symbols of a chunk stand in a repeated window. ``inside``: repeats in one document count too."""
    b = Blocks(spec, data, offsets)
    at = np.arange(len(b.first))
    change = np.zeros(len(b.sums) + 1, dtype=np.int64)

    def cover(first: np.ndarray, last: np.ndarray) -> None:
        np.add.at(change, first, 1)
        np.add.at(change, last - 1 + spec.size, -1)

    partial = np.unique(rows)
    if len(partial):
        at = at[np.isin(b.row, partial)]
        whole = _having(b.keys(at), b.row[at], keys, rows)
        cover(b.first[at[whole]], b.last[at[whole]])
        at = at[~whole]
        for width in (spec.parts, 1) if spec.parts else (1,):
            block, first, last, _, key = b.split(at, width)
            part = _having(key, b.row[block], keys, rows)
            cover(first[part], last[part])
    if inside:
        mark = rolling.mix64(b.hash + b.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, which, count = np.unique(mark, return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[which] > 1)
        block, first, last, _, key = b.split(again, 1)
        order = np.lexsort((first, key, b.row[block]))
        later = np.zeros(len(order), dtype=bool)
        later[1:] = (key[order][1:] == key[order][:-1]) & (b.row[block][order][1:] == b.row[block][order][:-1])
        cover(first[order[later]], last[order[later]])
    return b, np.cumsum(change)[: len(b.sums) - 1] > 0
