"""Suffix-array deduplication by a depth-limited radix sort.

Two suffixes belong together if their first ``size`` bytes agree; what follows is never looked at.
Suffixes are split into groups by most-significant-digit passes and a group of one is dropped after
each pass, so that after the last pass the groups of more than one are exactly the repeated windows.
The digits are content-chosen (see :mod:`.repeats`): an anchor gram, a block of windows, a part of it,
the window. Every byte of a window that starts earlier in the corpus is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats, rolling

SIZE = 100
GRAM = 40
PARTS = 8


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def deduplicate(docs: DataFrame, size: int = SIZE, gram: int = GRAM, parts: int = PARTS, text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and kept, and ``carry``.

    ``spans`` are the maximal removed runs as [start, end) byte offsets; ``kept`` is what is left, as
    binary (a cut may fall inside a character). Windows are judged on the input: a byte goes if a window
    of ``size`` bytes that covers it also starts in a document with a smaller id, or earlier in the same
    row. Of rows with equal ids none is earlier.

    Defined results: a null text is empty; texts shorter than ``size`` stay whole; a null id counts as
    the greatest, with 2^63 - 1; equal texts lose everything but for the least id; an empty table gives no rows; other
    columns are ignored unless named in ``carry``. Windows are compared by 64-bit hash within groups of
    equal anchor hash. A task holds some 60 times the bytes of its longest text.
    """
    spec = repeats.Spec("bytes", size, gram, parts)
    also = [F.col(c).alias(f"also_{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(repeats.NO_ID)).alias("id"), F.col(text).alias("text"), F.col("doc_id").cast("long").alias("own_id"), *also)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
    passed = ["own_id", *[f"also_{i}" for i in range(len(also))]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, data, offsets in rolling.chunks(batch, 1):
                keys, of = repeats._listed(some)
                _, gone = repeats.covered(spec, data, offsets, keys, of, inside=True)
                out: list[list] = [[] for _ in names]
                for i in range(some.num_rows):
                    own, lost = data[offsets[i] : offsets[i + 1]], gone[offsets[i] : offsets[i + 1]]
                    start, end = _runs(lost)
                    left = own[~lost].tobytes() if len(start) else own.tobytes()
                    row = (len(own), int(lost.sum()), len(start), hashlib.sha256(left).hexdigest())
                    for column, value in zip(out, (*row, [{"start": int(a), "end": int(b)} for a, b in zip(start, end)], left)):
                        column.append(value)
                made = [pa.array(c, t) for c, t in zip(out, types)]
                yield pa.RecordBatch.from_arrays([some.column(c) for c in passed] + made, names=[*passed, *names])

    made = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept binary"
    schema = T.StructType([*[rows.schema[c] for c in passed], *T.StructType.fromDDL(made).fields])
    return repeats.repeated_keys(rows, spec).mapInArrow(cut, schema).select(
        F.col("own_id").alias("doc_id"),
        *names,
        *[F.col(f"also_{i}").alias(c) for i, c in enumerate(carry)],
    )
