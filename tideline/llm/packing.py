"""Best-fit packing of documents into fixed-length sequences.

Documents are tokenized on the executors and cut into pieces. All pieces of one length are alike to
a packer, so vector best-fit runs over the histogram of lengths, which has a bounded number of rows
whatever the input: open sequences with the same free tokens, documents and attention cost form one
state, and each step fills a whole state. The plan is a short list of runs - "pieces of this length
with these ranks go to these sequences at this offset" - that executors look up by rank.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

#: Ranks within a length are counted in so many salted parts.
SALTS = 256


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. Attention cost is the sum of squared piece lengths."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024


@functools.lru_cache(maxsize=2)
def _encoders(path: str):
    """The tokenizer of ``path`` and a faster encoder with the same vocabulary and merges."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    # Byte-level vocabularies write each byte as a printable character: printable ones as they are,
    # the others, in order, from code point 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return slow, fast, special


def encode(text: str, path: str) -> np.ndarray:
    """Ids of ``text``; special tokens written out in the text are read as the tokenizer reads them."""
    slow, fast, special = _encoders(path)
    if not any(s in text for s in special):
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException:  # the fast encoder's own panics on extreme texts are no Exception
            pass
    return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def pieces(
    docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Token pieces of every row of ``docs``: doc_id, piece, start, length, ids_crc32 (and ids if asked for).

    Documents of more than ``length`` tokens are cut; the first piece takes what does not fill one.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows: list[tuple] = []
                some = batch.slice(at, 1000)
                for doc_id, body in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    ids = np.append(encode(body or "", tokenizer), end_id).astype("<u4")
                    ends = range(len(ids) % length or length, len(ids) + 1, length) if len(ids) > length else [len(ids)]
                    start = 0
                    for k, end in enumerate(ends):
                        own = ids[start:end]
                        row = (doc_id, k, start, end - start, zlib.crc32(own.tobytes()))
                        rows.append((*row, own.tolist()) if with_ids else row)
                        start = end
                columns = zip(*rows) if rows else [[] for _ in names]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(cut, schema)


def best_fit(histogram: dict[int, int], capacity: Capacity, weights=(1.0, 1.0, 1.0), rule: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place ``histogram[length]`` pieces.

    Longest first. A piece goes to the open sequence that suits it best under every capacity: the one
    with the least weighted norm of what stays free (``norm``) or with the greatest weighted dot product
    of piece and free space (``dot``). Work depends on the number of lengths, not of pieces.
    """
    full = (capacity.tokens, capacity.documents, capacity.attention)

    def fits(state: tuple[int, int, int], n: int) -> int:
        return min(state[0] // n, state[1], state[2] // (n * n))

    def score(state: tuple[int, int, int], n: int) -> float:
        item = (n, 1, n * n)
        if rule == "dot":
            return -sum(w * (r / c) * (v / c) for w, r, v, c in zip(weights, state, item, full))
        return sum(w * ((r - v) / c) ** 2 for w, r, v, c in zip(weights, state, item, full))

    runs: list[tuple[int, int, int, int, int]] = []
    free: dict[tuple[int, int, int], list[list[int]]] = {}  # state: ranges [first, count] of sequences
    made = 0
    for n in sorted(histogram, reverse=True):
        left, rank = histogram[n], 0
        if left and not fits(full, n):
            raise ValueError(f"a piece of {n} tokens fits no sequence of {capacity}")
        while left:
            able = [s for s in free if fits(s, n)]
            state = min(able, key=lambda s: (score(s, n), s)) if able else full
            k = min(fits(state, n), left)
            if able:
                first, count = free[state].pop()
                if not free[state]:
                    del free[state]
            else:
                first, count = made, left // k
                made += count
            used = min(count, left // k)
            if used < count:
                free.setdefault(state, []).append([first + used, count - used])
            for i in range(k):
                runs.append((n, rank, used, first, full[0] - state[0] + i * n))
                rank += used
            left -= used * k
            after = (state[0] - k * n, state[1] - k, state[2] - k * n * n)
            if min(after) > 0:
                free.setdefault(after, []).append([first, used])
    return runs


def pack(cut: DataFrame, capacity: Capacity = Capacity(), weights=(1.0, 1.0, 1.0), rule: str = "norm") -> DataFrame:
    """``cut`` (rows of :func:`pieces`, read several times: stage it first) with ``sequence_id`` and ``offset``.

    Only the histogram of lengths, at most ``capacity.tokens`` rows, reaches the driver.
    """
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs = sorted(best_fit(histogram, capacity, weights, rule))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = salted.groupBy("length", "_salt").count().select(
        "length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    own = W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    # starts has at most capacity.tokens x SALTS rows of three numbers
    ranked = (
        salted.withColumn("_in", F.row_number().over(own) - 1)
        .join(F.broadcast(starts), ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.col("_in"))
        .drop("_salt", "_in", "_before")
    )
    keys = np.array([(n << 44) + rank for n, rank, *_ in runs], dtype=np.int64)
    values = np.array([(rank, sequence, offset) for _, rank, _, sequence, offset in runs], dtype=np.int64).reshape(-1, 3)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            run = values[np.searchsorted(keys, (batch.column("length").to_numpy() << 44) + rank, "right") - 1]
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(run[:, 1] + rank - run[:, 0]), pa.array(run[:, 2])],
                names=[*kept, "sequence_id", "offset"],
            )

    fields = [f for f in ranked.schema.fields if f.name != "_rank"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack all rows of ``docs`` (doc_id, text).

    Defined results: a null or empty text is the end id alone; rows with equal ids are packed each;
    an empty table gives no rows; further columns are ignored; a very long text is cut into full
    pieces, each a sequence of its own.
    """
    cut = staged(pieces(docs, tokenizer, capacity.tokens, text=text, with_ids=with_ids), "pieces")
    return pack(cut, capacity)
