"""Sharding by weighted rendezvous hashing (DataFrame operations only).

Every (record key, shard) pair has a hash in (0, 1]; the record goes to the shard with the
smallest ``-ln(hash) / weight``. A shard's share is its weight over the sum of weights, and a
further shard only takes the records for which it is the new minimum: no record moves between
old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, utf8

#: A shard's rows are numbered within so many sub-buckets, so that no task holds a whole shard.
SUB_BUCKETS = 256


def _score(key: Column, shard: int, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{shard}:"), key)), 1, 13)
    unit = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    return F.struct((-F.log(unit) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of ``key`` (a string column) among ``len(weights)`` weighted shards; weight 0 gets nothing."""
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("at least one shard needs a positive weight")
    return F.array_min(F.array(*[_score(key, i, w) for i, w in live]))["shard"]


def shard_rows(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 24,
    grown_weight: float = 1.0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Assign every row of ``docs`` to a shard, with a gapless slot inside it.

    Returns key, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``shard``, ``slot`` and
    ``grown_shard`` (the shard if one of weight ``grown_weight`` were added).

    Defined results: a null key hashes as the word ``null``; a null or empty text has size 8 and
    CRC 0; repeated keys share a shard and get neighbouring slots, equal rows in any order; an empty
    table gives no rows; further columns of any name are ignored. Only ids and sizes are shuffled.
    """
    body = utf8(F.coalesce(F.col(text), F.lit("")))
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    n = len(weights)
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        rendezvous(name, weights).alias("shard"),
        rendezvous(name, [*weights, grown_weight]).alias("grown_shard"),
        F.conv(F.substring(F.md5(name), 1, 2), 16, 10).cast("int").alias("_sub"),
    )
    rows = staged(rows, "shards")
    before = W.partitionBy("shard").orderBy("_sub").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "_sub")
        .count()
        .select("shard", "_sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    order = W.partitionBy("shard", "_sub").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    # starts has at most shards x SUB_BUCKETS rows, whatever the input.
    return (
        rows.withColumn("_rank", F.row_number().over(order) - 1)
        .join(F.broadcast(starts) if n * SUB_BUCKETS <= 100_000 else starts, ["shard", "_sub"])
        .select(
            key,
            "size",
            "text_crc32",
            "shard",
            (F.col("_start") + F.col("_rank")).alias("slot"),
            "grown_shard",
        )
    )
