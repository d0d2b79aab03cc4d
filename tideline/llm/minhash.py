"""Near-duplicates by min-max hashing, banding and exact confirmation.

1. Every document's shingle set is hashed under each permutation once; minimum and maximum are both
   kept, and bands of signature values are its bucket keys. Equal sets form one class with one
   representative, so copies are never compared.
2. In every bucket the representatives are compared with one centre (by hash, another in each bucket)
   on their full sets; links give first components.
3. In buckets that still hold several components, bucket mates of different components are compared by
   their signatures, in blocks of bounded size. Only signatures of a byte a value are moved for that.
   Pairs that can still be similar are confirmed on their full sets, each pair in the first bucket that it
   shares; a text goes only to buckets in which it has such a pair. Tasks return documents and links, not pairs.
Nothing is capped: what a round does not decide, the next one compares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling, signatures
from .common import staged
from .components import components
from .repeats import NO_ID

SHINGLE = 5
PERCENT = 75
#: 72 permutations give 144 values, in 36 bands of 4: a pair at 0.75 is missed with probability 1e-6.
PERMUTATIONS = 72
BAND_ROWS = 4
#: Documents in a block of the last round, bytes compared at a time, and standard deviations below the
#: threshold at which a pair's estimated similarity spares its exact confirmation (misses 1 in 10 million).
BLOCK = 1024
COMPARED = 2**24
DEVIATIONS = 5.2


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """Size, key, bands and signature of each row's set. ``sign`` has the low byte of each signature value:
    it agrees wherever the value does, and by chance 1 time in 256."""
    schema = "id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>, sign binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, data, offsets in rolling.chunks(batch, 1):
                hashes, at = signatures.shingle_sets(data, offsets, size)
                n = np.diff(at)
                k1, k2 = signatures.set_keys(hashes, at)
                values = signatures.min_max(hashes, at, PERMUTATIONS)
                bands = signatures.band_keys(values, BAND_ROWS)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands.shape[1], 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64)))
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, values.shape[1], 0))]).astype(np.int32)
                low = np.ascontiguousarray((values & np.uint64(255)).astype(np.uint8))
                sign = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(low)])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(n.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists, sign],
                    names=["id", "n", "k1", "k2", "bands", "sign"],
                )

    return docs.mapInArrow(run, schema)


def _similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Of rows of two lists of sets (hashes, offsets): which pairs reach the similarity."""
    na, nb = np.diff(a[1]), np.diff(b[1])
    row = lambda n: np.repeat(np.arange(len(n)), n)
    hashes, rows = np.concatenate([a[0], b[0]]), np.concatenate([row(na), row(nb)])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    twice = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    both = np.bincount(rows[1:][twice], minlength=len(na))
    return (both > 0) & (100 * both >= percent * (na + nb - both))


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, data, offsets in rolling.chunks(batch, 2):
                at = 0
                one = signatures.shingle_sets(data, offsets, size)
                for part, other, bounds in rolling.chunks(some, 3):
                    own = one[1][at : at + part.num_rows + 1]
                    yes = _similar((one[0][own[0] : own[-1]], own - own[0]), signatures.shingle_sets(other, bounds, size), percent)
                    at += part.num_rows
                    yield part.select(["a", "b"]).filter(pa.array(yes))

    return rows.mapInArrow(run, "a bigint, b bigint")


CELL = ["key", "bi", "bj"]


def _candidates(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one pair of blocks of a bucket that may be similar, and how many bytes agree.

    They lie in different components, and this bucket is the first one that they share.
    """
    least = percent / 100 - DEVIATIONS * np.sqrt(percent / 100 * (1 - percent / 100) / (2 * PERMUTATIONS))
    ids, comp, n, block = (group.column(c).to_numpy() for c in ("id", "comp", "n", "block"))
    sign = np.frombuffer(b"".join(group.column("sign").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
    bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    key, bi, bj = (group.column(c)[0].as_py() for c in CELL)
    first, second = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    rows = max(1, COMPARED // max(1, sign.shape[1] * len(second)))
    found = [(first[:0], first[:0], first[:0])]
    for at in range(0, len(first), rows):
        part = first[at : at + rows]
        agree = np.count_nonzero(sign[part, None] == sign[None, second], axis=2)
        alike = (agree >= least * sign.shape[1]) & (comp[part, None] != comp[None, second])
        alike &= 100 * np.minimum(n[part, None], n[None, second]) >= percent * np.maximum(n[part, None], n[None, second])
        if bi == bj:
            alike &= ids[part, None] < ids[None, second]
        p, q = np.nonzero(alike)
        i, j = part[p], second[q]
        shared = bands[i] == bands[j]
        own = shared.any(axis=1) & (bands[i, shared.argmax(axis=1)] == key)
        found.append((i[own], j[own], agree[p, q][own]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _with_candidates(percent: int):
    def run(group: pa.Table) -> pa.Table:
        i, j, _ = _candidates(group, percent)
        return group.take(pa.array(np.union1d(i, j)))

    return run


def _cell_links(size: int, percent: int):
    """Links among the candidates of one pair of blocks, one for each component that is joined there."""

    def run(group: pa.Table) -> pa.Table:
        group, sets = group.combine_chunks(), []
        for batch in group.select(["text"]).to_batches():
            for _, data, offsets in rolling.chunks(batch, 0):
                hashes, at = signatures.shingle_sets(data, offsets, size)
                sets += [hashes[lo:hi] for lo, hi in zip(at[:-1], at[1:])]
        i, j, agree = _candidates(group, percent)
        order = np.argsort(-agree, kind="stable")
        ids, comp = group.column("id").to_numpy(), group.column("comp").to_numpy().copy()
        found = []
        for x, y in zip(i[order].tolist(), j[order].tolist()):
            if comp[x] == comp[y]:  # joined meanwhile
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                found.append((ids[x], ids[y]))
                comp[comp == comp[y]] = comp[x]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Documents are linked if the Jaccard similarity of their sets of ``size``-word shingles is at least
    ``percent`` hundredths; a component is named by its smallest id, which is the one that is kept.

    Defined results: words are lower-cased in A-Z only; fewer words than a shingle form one shingle; a
    text without words, or null, has an empty set, is linked with nothing and kept; equal texts are
    linked; a null id counts as the greatest, and ids are below 2^63 - 1; rows with equal ids are judged by their own texts; an
    empty table gives no rows; other columns are ignored. Shingles are compared by 64-bit hash. A task
    holds the shingles of its longest text.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    signed = staged(_signed(rows, size), "signed")
    classes = signed.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"))
    members = signed.select("id", "n", "k1", "k2").join(classes, ["k1", "k2", "n"], "left")
    members = staged(members.select("id", "n", F.coalesce("rep", "id").alias("rep")), "classes")

    heads = signed.join(members.where("n > 0").select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    keyed = heads.select("id", F.explode("bands").alias("key")).distinct()
    centre = F.min(F.struct(F.xxhash64("id", "key").alias("h"), F.col("id").alias("id")))["id"]
    buckets = keyed.groupBy("key").agg(centre.alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = staged(keyed.join(buckets, "key"), "buckets")
    # read twice in one plan, so that Spark moves these texts once
    texts = staged(rows.join(buckets.select("id").distinct(), "id", "left_semi"), "texts")

    pairs = buckets.where("id != centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    links = staged(_confirmed(pairs, texts, size, percent), "links")
    first = staged(
        buckets.select("id")
        .distinct()
        .join(components(links, "first").withColumnRenamed("node", "id"), "id", "left")
        .select("id", F.coalesce("component", "id").alias("comp")),
        "first",
    )
    several = buckets.join(first, "id")
    mixed = several.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    left = several.join(mixed, "key").select("key", "id", "comp").join(heads.select("id", "n", "sign", "bands"), "id")
    left = staged(left, "undecided")
    sizes = left.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = (
        left.join(sizes, "key")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
    )
    placed = placed.select(*CELL, "id", "comp", "n", "sign", "bands", "block")
    may = staged(placed.groupBy(*CELL).applyInArrow(_with_candidates(percent), placed.schema), "candidates")
    more = may.join(texts, "id").groupBy(*CELL).applyInArrow(_cell_links(size, percent), "a bigint, b bigint")
    linked = components(links.unionByName(staged(more, "more")), "linked")
    named = members.join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    hidden = lambda c: F.when(c != NO_ID, c)
    return named.select(
        hidden(F.col("id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        hidden(component).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
