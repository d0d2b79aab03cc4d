"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, found by a GNAT.

A geometric near-neighbour access tree is laid over the entries of each part's codebook. A node has a few split
points; every other entry belongs to the child of its nearest split point, and the node stores for each pair of
split points (i, j) the range of distances from i to all entries on j's side. A query measures its distance to a
split point and drops, as a whole, every side whose range lies strictly beyond the best distance so far. Distances
are integers squared; their roots are rounded towards keeping a side, so that nothing is dropped that could be as
near as the best entry, and ties are settled on the integers, the lower number first.

Codebooks are refined in rounds. Each round is one pass over the stored integer vectors: a task adds up its own
parts, Spark adds up the tasks, and the entries, a fixed number of integers, are what reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Split points of a node.
DEGREE = 4
#: Greatest magnitude of an integer component, so that a vector's error fits in 64 bits.
MOST = 1 << 24
#: Roots of integers below 2**63, and their sums, are off by far less than this share.
SLACK = 1e-12
#: Vectors that are measured at a time.
ROWS = 8192
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


@dataclass
class Node:
    """Entry numbers of the split points, distance ranges [split, side], and a child for each side that has more entries.

    A side's range has its split point and all entries below it; the diagonal has those below it alone.
    """

    splits: list[int]
    low: np.ndarray
    high: np.ndarray
    children: list[Node | None]


def _squared(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    return ((points - point) ** 2).sum(axis=1)


def build(entries: np.ndarray, own: list[int] | None = None, degree: int = DEGREE) -> Node:
    """Tree over ``entries`` (int64 rows): split points far from each other, the rest with the nearest of them."""
    own = list(range(len(entries))) if own is None else own
    splits, gap = [own[0]], _squared(entries[own], entries[own[0]])
    while len(splits) < min(degree, len(own)):
        gap[[own.index(s) for s in splits]] = -1
        splits.append(own[int(gap.argmax())])
        gap = np.minimum(gap, _squared(entries[own], entries[splits[-1]]))
    rest = [e for e in own if e not in splits]
    to_split = np.array([_squared(entries[own], entries[s]) for s in splits])
    side = {e: int(to_split[:, own.index(e)].argmin()) for e in rest}
    k = len(splits)
    low, high, children = np.full((k, k), np.inf), np.full((k, k), -np.inf), []
    for j in range(k):
        below = [e for e in rest if side[e] == j]
        for i in range(k):
            members = [own.index(e) for e in (below if i == j else [splits[j], *below])]
            if members:
                far = np.sqrt(to_split[i, members].astype(float))
                low[i, j], high[i, j] = far.min() * (1 - SLACK), far.max() * (1 + SLACK)
        children.append(build(entries, below, degree) if below else None)
    return Node(splits, low, high, children)


def nearest(tree: Node, entries: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of each query's nearest entry, the squared distance to it, and how many distances were measured."""
    best, index, measured = np.full(len(queries), np.iinfo(np.int64).max), np.zeros(len(queries), dtype=np.int64), 0
    todo = [(tree, np.arange(len(queries)))]
    while todo:
        node, rows = todo.pop()
        alive = np.ones((len(rows), len(node.splits)), dtype=bool)
        for i, entry in enumerate(node.splits):
            at = np.flatnonzero(alive[:, i])
            own = rows[at]
            d2 = _squared(queries[own], entries[entry])
            measured += len(own)
            better = (d2 < best[own]) | ((d2 == best[own]) & (entry < index[own]))
            best[own[better]], index[own[better]] = d2[better], entry
            far, reach = np.sqrt(d2.astype(float))[:, None], np.sqrt(best[own].astype(float))[:, None] * (1 + SLACK)
            beyond = (far * (1 - SLACK) - reach > node.high[i]) | (far * (1 + SLACK) + reach < node.low[i])
            alive[at] &= ~beyond
        for j, child in enumerate(node.children):
            if child is not None and alive[:, j].any():
                todo.append((child, rows[alive[:, j]]))
    return index, best, measured


class Codebooks:
    """Entries by part, entry and position, and a tree over each part's."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.trees = [build(part) for part in entries]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry number and squared distance of each vector's parts."""
        cut = vectors.reshape(len(vectors), len(self.trees), -1)
        found = [nearest(tree, own, cut[:, p])[:2] for p, (tree, own) in enumerate(zip(self.trees, self.entries))]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integer_vectors(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label and ``x``, the components times ``scale`` rounded down; rows without a usable vector go.

    ``x`` is null where a component is beyond what 64-bit arithmetic takes.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = batch.column(2)
            sizes = array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = array.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component is NaN
            owner = np.repeat(np.arange(len(sizes)), sizes)
            good = array.is_valid().to_numpy(zero_copy_only=False).copy()
            good[owner[~np.isfinite(flat)]] = False
            with np.errstate(all="ignore"):
                whole = np.floor(flat * scale)
            fits = good.copy()
            fits[owner[~(np.abs(whole) <= MOST)]] = False
            lengths = np.where(fits, sizes, 0)
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.append(~fits, False))
            x = pa.ListArray.from_arrays(ends, pa.array(whole[fits[owner]].astype(np.int32)))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], names=["vec_id", "label", "x"])
            yield out.filter(pa.array(good))

    return rows.select("vec_id", "label", vector).mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<int>")


def _blocks(column: pa.ListArray, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of those of length ``dim``, some at a time."""
    fits = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    for at in range(0, len(fits), ROWS):
        some = fits[at : at + ROWS]
        yield some, column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def first_entries(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """Codebooks to begin with: the parts of the vectors with the least ids. None where no vector can be coded."""
    order = [F.asc_nulls_last("vec_id"), F.asc("x")]
    usable = vectors.where(f"size(x) > 0 and size(x) % {parts} = 0")
    head = usable.orderBy(*order).select(F.size("x").alias("n")).first()
    if head is None:
        return None
    rows = usable.where(F.size("x") == head["n"]).orderBy(*order).limit(entries).select("x").collect()
    return np.array([r["x"] for r in rows], dtype=np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries after one round: the mean, rounded down, of the parts that each is nearest to; unused ones stay."""
    parts, entries, width = books.shape
    codebooks = Codebooks(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for _, own in _blocks(batch.column(0), parts * width):
                index, _ = codebooks.assign(own)
                cut = own.reshape(len(own), parts, width)
                for p in range(parts):
                    n[p] += np.bincount(index[:, p], minlength=entries)
                    for e in np.unique(index[:, p]):
                        total[p, e] += cut[index[:, p] == e, p].sum(axis=0)
        place = np.indices(books.shape).reshape(3, -1)
        used = np.repeat(n.ravel(), width)
        columns = [*place, total.ravel(), used]
        some = used > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in columns], names=["part", "entry", "position", "total", "n"])

    sums = vectors.select("x").mapInArrow(run, "part bigint, entry bigint, position bigint, total bigint, n bigint")
    after = books.copy()
    # a row for each integer of the codebooks
    for r in sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        after[r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
    return after


def coded(vectors: DataFrame, codebooks: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error; null where a vector does not suit the codebooks."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    parts, _, width = codebooks.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list[str | None] = [None] * batch.num_rows
            error, known = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=bool)
            for at, own in _blocks(batch.column(2), parts * width):
                index, d2 = codebooks.assign(own)
                digits = index.astype(np.uint8).tobytes().hex()
                for k, i in enumerate(at.tolist()):
                    codes[i] = digits[2 * parts * k : 2 * parts * (k + 1)]
                error[at], known[at] = d2.sum(axis=1), True
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error, mask=~known)], names=["vec_id", "label", "code", "error"]
            )

    return vectors.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def compress(rows: DataFrame, vector: str = "embedding", rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """Codes of the rows (vec_id, label, vector) with their errors and label_error, and the codebooks behind them.

    Defined results: rows whose vector is null or has null or non-finite components go. Vectors of another length
    than the one with the least id that can be cut into ``parts``, empty ones, and those with a component beyond
    2**24 once scaled stay without code and error and take no part in the codebooks. A null id comes after all
    others; rows with equal ids are coded each, and their vectors settle which comes first; labels that are null
    are one label. With fewer than ``entries`` vectors there are as many entries; an empty table gives no rows and
    no codebooks. Further columns are ignored.
    """
    vectors = staged(integer_vectors(rows, vector, scale), "integers")
    books = first_entries(vectors, parts, entries)
    if books is None:
        return vectors.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), None
    for _ in range(rounds):
        books = refined(vectors, books)
    codebooks = Codebooks(books)
    codes = staged(coded(vectors, codebooks), "codes")
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(F.coalesce(F.sum("error"), F.lit(0)).alias("label_error"))
    return codes.join(by_label, codes["label"].eqNullSafe(by_label["_label"])).drop("_label"), codebooks
