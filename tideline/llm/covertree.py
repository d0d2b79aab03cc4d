"""Embedding near-dedup by a cover tree and a dual traversal.

Vectors are unit vectors, so that cosine 0.98 is Euclidean distance 0.2. A cover tree is laid over a bounded
sample: its levels are nested nets with halving radii, whose points are vectors, more than the radius
apart from each other and within the parent's radius of their parent; a parent is its own first child.
Points with few vectors of the sample around them stay in their parent's bucket. Every vector goes down
the tree to its bucket, and each bucket's covering radius is the greatest distance found among all of its
vectors. Buckets are cut into blocks of bounded size, and each block goes on with the levels below, over all of
its vectors, down to single ones (:func:`descent`).

The dual traversal then walks pairs of nodes, first of the buckets, then of the blocks of those that are
left: a pair whose centres are farther apart than both radii and the threshold is pruned with all below it; a
pair so close that every two vectors must be linked is counted without comparing; pairs of single vectors are
compared exactly.

Vectors that are nobody's neighbours, such as random ones in many dimensions, are all farther apart than any
radius that could tell them from each other: there each is a node of its own, and a comparison of two nodes is one of
two vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged
from .components import components

COSINE = 0.98
#: The tree is laid over so many vectors at most, those with the least hash of their id.
SAMPLE = 4096
#: A net's point becomes a node if so many of the sample are its own.
LEAST = 16
FINEST = 0.0625
#: Radii of the levels inside a block; below the last are the vectors.
LEVELS = (0.5, 0.25, 0.125, 0.0625)
#: Products of vectors that take as long as going down one pair of nodes. Decides how, never what is found.
STEP = 1500
#: Vectors in a block of a comparison, and rows of it that are multiplied at a time.
BLOCK, ROWS = 4096, 512
SLACK = 1e-7
#: Classes of vectors without an id have a name from here on inside; ids are smaller.
NO_ID = 2**63 - 2**40


@dataclass
class Tree:
    """Node i has a centre, the radius of its net, and its parent; node 0 is the root."""

    centre: np.ndarray
    radius: np.ndarray
    parent: np.ndarray

    def children(self, node: int) -> np.ndarray:
        return np.flatnonzero(self.parent == node)

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node where each vector's descent ends, and its distance to that node's centre."""
        node = np.zeros(len(vectors), dtype=np.int64)
        active = [0]
        while active:
            at = active.pop()
            below, own = self.children(at), np.flatnonzero(node == at)
            if not len(below) or not len(own):
                continue
            distance = _distances(vectors[own], self.centre[below])
            best = distance.argmin(axis=1)
            inside = distance[np.arange(len(own)), best] <= self.radius[below[best]]
            node[own[inside]] = below[best[inside]]
            active += below.tolist()
        return node, np.sqrt(((vectors - self.centre[node]) ** 2).sum(axis=1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def grow(sample: np.ndarray) -> Tree:
    """Nested nets with halving radii over ``sample``, a node only where a net's point has enough of it.

    A level at which nothing parts, or nothing has enough, is left out, as in a tree without its chains.
    """
    centre, radius, parent = [sample[0] if len(sample) else np.zeros(1)], [2.0], [-1]
    todo = [(0, sample)]
    while todo:
        at, own = todo.pop()
        r = radius[at] / 2
        while r >= FINEST and len(own) >= 2 * LEAST:
            # greedy net: the parent's own point first, then points of what no earlier one covers
            left, found, point = own, [], centre[at]
            while len(left) >= LEAST:
                near = _distances(left, point[None])[:, 0] <= r
                if near.sum() >= LEAST:
                    found.append((point, left[near]))
                left = left[~near]
                point = left[0] if len(left) else point
            if found:
                for point, part in found:
                    centre.append(point)
                    radius.append(r)
                    parent.append(at)
                    todo.append((len(centre) - 1, part))
                break
            r /= 2
    return Tree(np.array(centre), np.array(radius), np.array(parent))


def traverse(tree: Tree, covering: np.ndarray, threshold: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs of nodes (a <= b) whose own vectors must be compared, and pairs where all are linked.

    ``covering`` has the greatest distance of a node's own vectors to its centre, -1 where it has none.
    """
    below = covering.copy()
    for i in range(len(below) - 1, 0, -1):
        up = tree.parent[i]
        step = np.sqrt(((tree.centre[i] - tree.centre[up]) ** 2).sum())
        if below[i] >= 0:
            below[up] = max(below[up], below[i] + step)
    compare, linked, todo, seen = [], [], [(0, 0)], set()
    while todo:
        a, b = todo.pop()
        if (a, b) in seen or below[a] < 0 or below[b] < 0:
            continue
        seen.add((a, b))
        apart = np.sqrt(((tree.centre[a] - tree.centre[b]) ** 2).sum())
        if apart - below[a] - below[b] > threshold + SLACK:
            continue
        if covering[a] >= 0 and covering[b] >= 0 and apart - covering[a] - covering[b] <= threshold + SLACK:
            (linked if apart + covering[a] + covering[b] <= threshold - SLACK else compare).append((a, b))
        for x in tree.children(a):
            todo.append((min(x, b), max(x, b)))
        for y in tree.children(b):
            todo.append((min(a, y), max(a, y)))
    return compare, linked


def _net(x: np.ndarray, radius: float, first: int) -> np.ndarray:
    """The net's point that each vector belongs to: ``first``, then greedily whatever no earlier point covers."""
    near = np.concatenate([x[i : i + ROWS] @ x.T >= 1 - radius * radius / 2 for i in range(0, len(x), ROWS)])
    owner = np.full(len(x), -1)
    for i in [first, *range(len(x))]:
        if owner[i] < 0:
            near[i, i] = True
            owner[near[i] & (owner < 0)] = i
    return owner


def descent(x: np.ndarray) -> np.ndarray:
    """For each unit vector its node on every level of ``LEVELS``, as the row of the node's centre; nested nets over all of ``x``."""
    path = np.repeat(np.arange(len(x))[:, None], len(LEVELS), axis=1)  # a vector alone is its own node from there on
    cells = [(np.arange(len(x)), 0)] if len(x) > 1 else []
    for level, radius in enumerate(LEVELS):
        below = []
        for own, centre in cells:
            owner = own[_net(x[own], radius, int(np.searchsorted(own, centre)))]
            path[own, level] = owner
            found, sizes = np.unique(owner, return_counts=True)
            below += [(own[owner == c], int(c)) for c in found[sizes > 1]]
        cells = below
    return path


def dual(x: np.ndarray, path: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Links of the rows ``a`` of ``x`` (unit vectors) with its rows ``b``: the same rows, or others.

    ``path`` has the node of each row on every level (:func:`descent`), ``count`` how often its vector is there. Gives
    for each row how many rows it is linked to, pairs of rows that connect what is linked, and how many products of two
    vectors it took. Where bounds leave so many pairs of nodes that going down costs more than comparing all
    that is below, that is compared.
    """
    threshold, last = float(np.sqrt(2 - 2 * cosine)), path.shape[1] - 1
    links, met, work = np.zeros(len(x), dtype=np.int64), [(a[:0], b[:0])], 0
    cover, order, starts, ends = [], [], [], []
    for level in range(path.shape[1]):
        node = path[:, level]
        cover.append(np.zeros(len(x)))
        np.maximum.at(cover[-1], node, np.sqrt(((x - x[node]) ** 2).sum(axis=1)))
        order.append(np.argsort(node, kind="stable"))
        size = np.bincount(node, minlength=len(x))
        ends.append(np.cumsum(size))
        starts.append(ends[-1] - size)

    def members(level: int, node: int) -> np.ndarray:
        return order[level][starts[level][node] : ends[level][node]]

    def link(close: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        i, j = np.nonzero(close)
        np.add.at(links, p[i], count[q[j]])
        np.add.at(links, q[j], count[p[i]])
        met.append((p[i], q[j]))

    def exact(p: np.ndarray, q: np.ndarray, upper: bool) -> int:
        """Compare rows ``p`` with ``q``; with ``upper``, where ``q`` begins with ``p``, only with later ones."""
        done = 0
        for at in range(0, len(p), ROWS):
            part, other = p[at : at + ROWS], q[at:] if upper else q
            close = x[part] @ x[other].T >= cosine
            link(np.triu(close, 1) if upper else close, part, other)
            done += close.size
        return done

    same = len(a) == len(b) and bool((a == b).all())
    todo = [(0, np.unique(path[a, 0]), np.unique(path[b, 0]), same)] if len(a) and len(b) else []
    while todo:
        level, left, right, upper = todo.pop()
        size = ends[level] - starts[level]
        below = np.concatenate([members(level, c) for c in right])
        bounds = np.concatenate([[0], np.cumsum(size[right])])
        for at in range(0, len(left), ROWS):
            part, other = left[at : at + ROWS], right[at:] if upper else right
            product = x[part] @ x[other].T
            work += product.size
            wide, single, wide_other = np.flatnonzero(size[part] > 1), np.flatnonzero(size[part] == 1), np.flatnonzero(size[other] > 1)
            pairs = []
            for rows, columns in ((wide, np.arange(len(other))), (single, wide_other)):
                apart = np.sqrt(np.maximum(2 - 2 * product[np.ix_(rows, columns)], 0))
                reach = cover[level][part[rows]][:, None] + cover[level][other[columns]]
                i, j = np.nonzero(apart - reach <= threshold + SLACK)
                pairs += [p for p in zip(rows[i], columns[j], (apart + reach)[i, j] <= threshold - SLACK) if not upper or p[0] <= p[1]]
            if len(pairs) * STEP > size[part].sum() * size[other].sum():
                # where both sides are one, the part's vectors are the first of those below
                own = below[bounds[at] : bounds[at + len(part)]] if upper else np.concatenate([members(level, c) for c in part])
                work += exact(own, below[bounds[at] :] if upper else below, upper)
                continue
            close = product >= cosine
            close[wide], close[:, wide_other] = False, False
            link(np.triu(close, 1) if upper else close, part, other)
            for i, j, whole in pairs:
                p, q, itself = members(level, part[i]), members(level, other[j]), upper and i == j
                if whole:
                    links[p] += count[q].sum() - (count[p] if itself else 0)
                    links[q] += 0 if itself else count[p].sum()
                    met += [(p, np.full(len(p), other[j])), (q, np.full(len(q), part[i]))]
                elif level == last:
                    work += exact(p, q, itself)
                else:
                    todo.append((level + 1, np.unique(path[p, level + 1]), np.unique(path[q, level + 1]), itself))
    p, q = (np.concatenate(c) for c in zip(*met))
    return links, p, q, work


def unit_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label and ``unit`` (array of doubles; null where the vector links with nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = batch.column(2)
            sizes = array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = array.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component is NaN
            starts = np.cumsum(sizes) - sizes
            lengths, mask, values = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=bool), []
            some = np.flatnonzero(sizes)
            if len(some):
                with np.errstate(all="ignore"):
                    top = np.maximum.reduceat(np.abs(flat), starts[some])
                    x = flat / np.repeat(top, sizes[some])  # first by the greatest, so that no square overflows
                    x = x / np.repeat(np.sqrt(np.add.reduceat(x * x, starts[some])), sizes[some]) + 0.0
                good = np.isfinite(top) & (top > 0)
                lengths[some[good]], mask[some[good]] = sizes[some[good]], False
                values = x[np.repeat(good, sizes[some])]
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.append(mask, False))
            units = pa.ListArray.from_arrays(ends, pa.array(values, pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), units], names=["vec_id", "label", "unit"])

    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), vector).mapInArrow(run, "vec_id bigint, label string, unit array<double>")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(array), -1) if len(array) else np.zeros((0, 1))


def _descended(group: pa.Table) -> pa.Table:
    """A block with the place of each vector in it and its node on every level, as that place."""
    path = descent(_matrix(group.column("unit")))
    places = pa.array(np.arange(len(path)))
    paths = pa.ListArray.from_arrays(pa.array(np.arange(len(path) + 1) * len(LEVELS), pa.int32()), pa.array(path.reshape(-1)))
    return group.append_column("place", places).append_column("path", paths)


def _compared(cosine: float):
    """Per vector of a pair of blocks: how many rows it is linked to, and the least id it reaches in it."""

    def run(group: pa.Table) -> pa.Table:
        ids, count, place = (group.column(c).to_numpy() for c in ("rep", "n", "place"))
        path, sides = _matrix(group.column("path")).copy(), []
        for side in ("in_a", "in_b"):
            rows = np.flatnonzero(group.column(side).to_numpy(zero_copy_only=False))
            rows = rows[np.argsort(place[rows])]
            sides.append(rows)
        a, b = sides
        for rows in [a] if len(a) == len(b) and (a == b).all() else sides:
            path[rows] = rows[path[rows]]
        links, p, q, _ = dual(_matrix(group.column("unit")), path, count, a, b, cosine)
        least = ids.copy()
        while True:
            before = least.copy()
            low = np.minimum(least[p], least[q])
            np.minimum.at(least, p, low)
            np.minimum.at(least, q, low)
            if (before == least).all():
                break
        some = links > 0
        return pa.table({"rep": ids[some], "links": links[some], "least": least[some]})

    return run


def near_duplicates(rows: DataFrame, vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``rows`` (vec_id, label, vector): vec_id, n_links, component_id and kept.

    Vectors with equal, non-null labels are linked if their cosine is at least ``cosine`` (0.5 at least).
    A component is named by its smallest id, which is kept.

    Defined results: a vector that is null, empty, zero, or holds null or non-finite components, or has
    no label, is linked with nothing; vectors are compared with those of their own length only; equal
    vectors form one class and are not compared; repeated ids are nodes of one name; a null id counts as the
    greatest, is never the name of a component with another id in it, and a component of null ids alone has
    no name and is not kept; an empty table gives no rows. The tree decides how fast this is, never what is
    found.
    """
    spark: SparkSession = rows.sparkSession
    threshold = float(np.sqrt(2 - 2 * cosine))
    units = staged(unit_vectors(rows, vector).withColumns({"own_id": F.col("vec_id"), "vec_id": F.coalesce("vec_id", F.lit(NO_ID))}), "units")
    usable = units.where("unit is not null and label is not null").withColumn("label", F.concat_ws(":", F.size("unit"), "label"))
    unnamed = F.lit(NO_ID) + F.pmod(F.xxhash64("label", "unit"), F.lit(2**40))
    classes = usable.groupBy("label", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = staged(classes.withColumn("rep", F.when(F.col("rep") == NO_ID, unnamed).otherwise(F.col("rep"))), "classes")
    members = usable.join(classes, ["label", "unit"]).select("own_id", "vec_id", "rep", F.col("n").alias("copies"))

    dims = [r[0] for r in classes.groupBy(F.size("unit")).count().orderBy(F.desc("count")).limit(1).collect()]
    dim = dims[0] if dims else 1
    picked = classes.where(F.size("unit") == dim).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("unit").collect()
    tree = grow(np.array([r[0] for r in picked], dtype=np.float64).reshape(-1, dim))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("unit")
            size = units.value_lengths().to_numpy(zero_copy_only=False)
            node, far = np.zeros(len(size), dtype=np.int64), np.full(len(size), 4.0)
            fits = np.flatnonzero(size == dim)
            if len(fits):
                node[fits], far[fits] = tree.assign(_matrix(units.take(pa.array(fits))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node), pa.array(far)], names=[*batch.schema.names, "node", "far"])

    placed = staged(classes.mapInArrow(descend, "label string, unit array<double>, rep bigint, n bigint, node bigint, far double"), "placed")
    covering = np.full(len(tree.radius), -1.0)
    for r in placed.groupBy("node").agg(F.max("far").alias("far")).collect():  # a row for each node of the tree
        covering[r["node"]] = r["far"]
    compare, linked = traverse(tree, covering, threshold)

    def pair_table(pairs: list[tuple[int, int]]) -> DataFrame:
        both = sorted({(int(a), int(b), int(x)) for a, b in pairs for x in (a, b)})
        return spark.createDataFrame(both, "a bigint, b bigint, node bigint")

    sizes = placed.groupBy("label", "node").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.sum("n").alias("total"), F.min("rep").alias("first"))
    sizes = staged(sizes, "sizes")
    blocks = placed.join(sizes.select("label", "node", "blocks"), ["label", "node"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    blocks = blocks.select("label", "node", "block", "unit", "rep", "n").groupBy("label", "node", "block")
    columns = "label string, node bigint, block bigint, unit array<double>, rep bigint, n bigint, place bigint, path array<bigint>"
    blocks = staged(blocks.applyInArrow(_descended, columns), "blocks")
    facing = (
        pair_table(compare)
        .withColumn("other", F.when(F.col("node") == F.col("a"), F.col("b")).otherwise(F.col("a")))
        .join(sizes.select("label", F.col("node").alias("other"), F.col("blocks").alias("facing")), "other")
    )
    in_a = F.col("node") == F.col("a")
    dealt = (
        blocks.join(facing, ["label", "node"])
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("facing") - 1)))
        .withColumns(
            {
                "i": F.when(F.col("a") == F.col("b"), F.least("block", "k")).when(in_a, F.col("block")).otherwise(F.col("k")),
                "j": F.when(F.col("a") == F.col("b"), F.greatest("block", "k")).when(in_a, F.col("k")).otherwise(F.col("block")),
            }
        )
        .withColumns({"in_a": in_a & (F.col("block") == F.col("i")), "in_b": (F.col("node") == F.col("b")) & (F.col("block") == F.col("j"))})
    )
    found = (
        dealt.select("label", "a", "b", "i", "j", "unit", "rep", "n", "place", "path", "in_a", "in_b")
        .groupBy("label", "a", "b", "i", "j")
        .applyInArrow(_compared(cosine), "rep bigint, links bigint, least bigint")
    )
    # all linked: every vector of one node with every vector of the other
    near = (
        pair_table(linked)
        .withColumn("other", F.when(F.col("node") == F.col("a"), F.col("b")).otherwise(F.col("a")))
        .join(sizes.select("label", F.col("node").alias("other"), "total", "first"), "other")
    )
    whole = placed.join(near, ["label", "node"]).select(
        "rep", (F.col("total") - F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("links"), F.least("rep", "first").alias("least")
    )
    found = staged(found.unionByName(whole.where("links > 0")), "found")
    linked_to = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")), "vectors")
    named = (
        members.join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(linked_to.withColumnRenamed("node", "rep"), "rep", "left")
        .select("own_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    alone = units.where("unit is null or label is null").select("own_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = named.unionByName(alone)
    component = F.when(F.col("component_id") < NO_ID, F.col("component_id")).alias("component_id")
    return both.select(F.col("own_id").alias("vec_id"), "n_links", component, F.coalesce(F.col("own_id") == F.col("component_id"), F.lit(False)).alias("kept"))
