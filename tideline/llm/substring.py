"""Substring deduplication by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id. It is indexed by content-chosen blocks of
words: a block is a run of windows of ``size`` words around one anchor, so equal texts are cut alike wherever
they stand. The index gives each block, and each window that is looked up alone, its first place: document and
word. A document is then parsed from left to right. A factor takes the block that comes next and goes on,
greedily, as long as the next one stands at the next place of the same reference document; it is a stretch of
words with a place in the reference. Where it ends, because the reference goes on differently, the windows
around the boundary are checked one by one, so that no repeated window is missed between two factors.

The index is built in three passes, each over what the one before left open: anchors that two documents share;
whole blocks of shared anchors; single windows of blocks that share an anchor but stand nowhere as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import repeats, rolling

SIZE = 13
GRAM = 5
FOUND = "g bigint, c bigint, id bigint, at int, sure boolean, ref bigint, ref_at int"
FACTOR = "struct<start:bigint,end:bigint,ref:bigint,ref_start:bigint>"

_long = repeats._long


def _places(g: np.ndarray, c: np.ndarray, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """One row for each group, key and document with its first place; all but the least document of a chunk are
    sure to repeat, and refer to that one."""
    order = np.lexsort((at, ids, c, g))
    g, c, ids, at = g[order], c[order], ids[order], at[order]
    head = np.ones(len(g), dtype=bool)
    head[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    sure = np.zeros(len(g), dtype=bool)
    sure[1:] = ~head[1:] & (ids[1:] != ids[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(g)), 0)) if len(g) else np.zeros(0, dtype=np.int64)
    rows = np.concatenate([np.flatnonzero(head), np.flatnonzero(sure)])
    is_sure = np.arange(len(rows)) >= head.sum()
    # what is decided already meets nobody: it is spread by document
    group = np.where(is_sure, rolling.mix64(c[rows] ^ rolling.mix64(ids[rows].astype(np.uint64))), g[rows])
    columns = [_long(group), _long(c[rows]), ids[rows], at[rows].astype(np.int32), is_sure, ids[first[rows]], at[first[rows]].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in FOUND.split(", ")])


def _decide(rows: DataFrame) -> DataFrame:
    """Rows with the first place of their key, ``repeated`` (in an earlier document), and ``split`` (the group has other keys)."""
    least = F.min(F.struct("id", "at")).over(W.partitionBy("g", "c"))
    group = W.partitionBy("g")
    found = rows.repartition("g").withColumn("_l", least).withColumn("split", F.min("c").over(group) < F.max("c").over(group))
    ref = F.when(F.col("sure"), F.struct(F.col("ref").alias("id"), F.col("ref_at").alias("at"))).otherwise(F.col("_l"))
    return found.select("g", "c", "id", ref.alias("_r"), "split").select("g", "c", "id", F.col("_r.id").alias("ref"), F.col("_r.at").alias("ref_at"), (F.col("_r.id") < F.col("id")).alias("repeated"), "split")


def _indexed(docs: DataFrame, spec: repeats.Spec) -> DataFrame:
    """``docs`` (id, text, others) with ``found``: keys of their blocks and windows that stand in the reference, and where.

    Every pass joins the same columns of ``docs``, so that Spark moves the texts once and reads that exchange again.
    """
    columns = docs.columns
    anchors = docs.select("id", "text").mapInArrow(repeats._chunked(spec, lambda b, some, ids: repeats._anchors_of(b.hash, ids[b.row])), repeats.ROWS)
    group = W.partitionBy("g")
    shared = anchors.withColumn("many", F.min("id").over(group) < F.max("id").over(group)).where("sure or many")
    todo = shared.select("id", F.col("c").alias("key")).groupBy("id").agg(F.collect_set("key").alias("keys"))

    def pass_over(todo: DataFrame, rows: Callable) -> DataFrame:
        joined = docs.join(todo, "id").select(*columns, "keys")
        return _decide(joined.mapInArrow(repeats._chunked(spec, rows), FOUND))

    def blocks(b: repeats.Blocks, some: pa.RecordBatch, ids: np.ndarray) -> pa.RecordBatch:
        some_of = np.flatnonzero(repeats._having(b.hash, b.row, *repeats._listed(some)))
        row = b.row[some_of]
        return _places(b.hash[some_of], b.keys(some_of), ids[row], b.first[some_of] - b.bounds[row])

    def windows(b: repeats.Blocks, some: pa.RecordBatch, ids: np.ndarray) -> pa.RecordBatch:
        listed = repeats._listed(some)
        open_ = np.flatnonzero(repeats._having(b.hash, b.row, *listed))
        open_ = open_[repeats._having(b.keys(open_), b.row[open_], *listed)]
        block, first, _, group, key = b.split(open_, 1)
        row = b.row[block]
        return _places(group, key, ids[row], first - b.bounds[row])

    whole = pass_over(todo, blocks)
    left = whole.where("not repeated and split").select("id", F.explode(F.array("g", "c")).alias("key"))
    single = pass_over(left.groupBy("id").agg(F.collect_set("key").alias("keys")), windows)
    hits = whole.where("repeated").unionByName(single.where("repeated")).select("id", F.struct("c", "ref", "ref_at").alias("hit"))
    found = hits.groupBy("id").agg(F.collect_list("hit").alias("hits"))
    lists = [F.col(f"hits.{c}").alias(name) for c, name in (("c", "keys"), ("ref", "refs"), ("ref_at", "places"))]
    return docs.join(found.select("id", *lists), "id", "left").select(*columns, "keys", "refs", "places")


def _lookup(b: repeats.Blocks, key: np.ndarray, row: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Index of each (row, key) among the sorted ``marks``, -1 where it is not there."""
    wanted = _mark(key, row)
    at = np.searchsorted(marks, wanted)
    at[at == len(marks)] = 0
    return np.where(marks[at] == wanted, at, -1) if len(marks) else np.full(len(key), -1)


def _mark(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    return rolling.mix64(key + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pieces(b: repeats.Blocks, keys: np.ndarray, of: np.ndarray, refs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What the index has of a chunk, in order: rows of (row, start, end, reference document, its word), words of the chunk.

    Whole blocks first; the windows of a block that is not there as a whole, those at the ends of factors, one by one.
    """
    order = np.argsort(_mark(keys, of))
    marks, refs, places = _mark(keys, of)[order], refs[order], places[order]
    size = b.spec.size
    some = np.flatnonzero(np.isin(b.row, np.unique(of)))
    hit = _lookup(b, b.keys(some), b.row[some], marks)
    whole, rest = some[hit >= 0], some[hit < 0]
    found = [(b.row[whole], b.first[whole], b.last[whole] - 1 + size, refs[hit[hit >= 0]], places[hit[hit >= 0]])]
    block, first, _, _, key = b.split(rest, 1)
    hit = _lookup(b, key, b.row[block], marks)
    yes = hit >= 0
    found.append((b.row[block][yes], first[yes], first[yes] + size, refs[hit[yes]], places[hit[yes]]))
    every = np.column_stack([np.concatenate(x).astype(np.int64) for x in zip(*found)])
    return every[np.lexsort((every[:, 1], every[:, 0]))]


def greedy(found: np.ndarray) -> np.ndarray:
    """Factors: a piece, and all that follow it for as long as the next one stands at the next place of the same document."""
    row, start, end, ref, place = found.T
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (ref[1:] != ref[:-1]) | (place[1:] - start[1:] != place[:-1] - start[:-1]) | (start[1:] > end[:-1])
    head = np.flatnonzero(new)
    stop = np.maximum.reduceat(end, head) if len(head) else head
    return np.column_stack([row[head], start[head], stop, ref[head], place[head]])


def parse(b: repeats.Blocks, keys: np.ndarray, of: np.ndarray, refs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a chunk that its factors cover, and the factors: rows of (row, start, end, reference document, its word), in order."""
    factors = greedy(pieces(b, keys, of, refs, places))
    # a factor of ``size`` words or more is a duplicate span
    row, begin, stop, ref, ref_start = factors[factors[:, 2] - factors[:, 1] >= b.spec.size].T
    change = np.zeros(len(b.sums) + 1, dtype=np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, stop, -1)
    gone = np.cumsum(change)[: len(b.sums) - 1] > 0
    # at a boundary the windows of two factors overlap: the later one is listed from where the earlier one ends
    late = np.zeros(len(row), dtype=np.int64)
    late[1:] = np.where(row[1:] == row[:-1], np.maximum(stop[:-1] - begin[1:], 0), 0)
    bounds = b.bounds[row]
    listed = np.column_stack([row, begin + late - bounds, stop - bounds, ref, ref_start + late])
    return gone, listed[begin + late < stop]


def deduplicate(docs: DataFrame, size: int = SIZE, gram: int = GRAM, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, factors and kept.

    ``factors`` are the duplicate spans, which are what is removed: [start, end) word numbers with the reference document and its word number,
    in order and without overlap; ``kept`` has the words that are left, joined by one space. A word goes if
    ``size`` consecutive words that cover it also stand in a document with a smaller id; windows are judged on
    the input.

    Defined results: a null text has no words; texts with fewer than ``size`` words stay whole; repeats
    inside one document stay; a null id counts as the greatest, with 2^63 - 1; rows with equal ids do not remove
    from each other; an empty table gives no rows; other columns are ignored. Windows are compared by 64-bit
    hash within groups of equal anchor hash. A task holds some 60 times the bytes of its longest text.
    """
    spec = repeats.Spec("words", size, gram)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(repeats.NO_ID)).alias("id"), F.col(text).alias("text"), F.col("doc_id").cast("long").alias("own_id"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "factors", "kept"]
    span = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "ref", "ref_start")]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, data, offsets in rolling.chunks(batch, 1):
                b = repeats.Blocks(spec, data, offsets)
                (keys, of), (refs, _), (places, _) = (repeats._listed(some, c) for c in ("keys", "refs", "places"))
                gone, factors = parse(b, keys, of, _long(refs), _long(places))
                words, raw = b.words, data.tobytes()
                ends = np.searchsorted(factors[:, 0], np.arange(some.num_rows + 1))
                out: list[list] = [[] for _ in names]
                for i, doc_id in enumerate(some.column("own_id").to_pylist()):
                    lost = gone[words.bounds[i] : words.bounds[i + 1]]
                    at = words.bounds[i] + (~lost).nonzero()[0]
                    left = b" ".join([raw[p:q] for p, q in zip(words.start[at].tolist(), words.end[at].tolist())])
                    own = [{"start": s, "end": e, "ref": r, "ref_start": p} for _, s, e, r, p in factors[ends[i] : ends[i + 1]].tolist()]
                    row = (doc_id, len(lost), int(lost.sum()), hashlib.sha256(left).hexdigest(), own, left.decode())
                    for column, value in zip(out, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    schema = f"doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, factors array<{FACTOR}>, kept string"
    return _indexed(rows, spec).mapInArrow(cut, schema)
