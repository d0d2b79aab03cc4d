"""Continuity, gaps, cursors, and the equivalence of two feeds."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RING, RESET, BUCKET = 1000, 17_280, 1 << 16


def continuity_breaks(ledgers: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Ledgers that do not name their predecessor's hash. A join by number, so that no task sees all.

    ``known`` (network, ledger_sequence, hash) are predecessors besides ``ledgers`` themselves.
    """
    hashes = ledgers.select("network", "ledger_sequence", "hash")
    hashes = hashes if known is None else hashes.unionByName(known.select("network", "ledger_sequence", "hash")).distinct()
    before = hashes.select("network", (F.col("ledger_sequence") + 1).alias("ledger_sequence"), F.col("hash").alias("expected"))
    joined = ledgers.join(before, ["network", "ledger_sequence"])
    return joined.where(~F.col("previous_hash").eqNullSafe(F.col("expected"))).select("network", "ledger_sequence", "previous_hash", "expected")


def sequence_gaps(ledgers: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Missing ranges between the ledgers of each network.

    With bounds, ledgers outside of them do not count, and what is missing at either end of them is a gap as well.
    Numbers are compared within buckets; only one row a bucket is left for the edges.
    """
    rows = ledgers.select("network", "ledger_sequence")
    if first is not None:
        rows = rows.where(F.col("ledger_sequence") >= first)
    if last is not None:
        rows = rows.where(F.col("ledger_sequence") <= last)
    # a ledger just outside each bound, for every network that has ledgers at all
    ends = [b for b in (None if first is None else first - 1, None if last is None else last + 1) if b is not None]
    if ends:
        outside = F.explode(F.array(*[F.lit(b).cast("long") for b in ends]))
        rows = rows.unionByName(ledgers.select("network").distinct().select("network", outside.alias("ledger_sequence")))
    rows = rows.distinct().withColumn("_b", F.expr(f"ledger_sequence div {BUCKET}"))
    inside = rows.withColumn("_next", F.lead("ledger_sequence").over(W.partitionBy("network", "_b").orderBy("ledger_sequence")))
    edges = rows.groupBy("network", "_b").agg(F.min("ledger_sequence").alias("_lo"), F.max("ledger_sequence").alias("ledger_sequence"))
    edges = edges.withColumn("_next", F.lead("_lo").over(W.partitionBy("network").orderBy("_b")))
    both = inside.where("_next is not null").select("network", "ledger_sequence", "_next").unionByName(edges.where("_next is not null").select("network", "ledger_sequence", "_next"))
    return both.where("_next > ledger_sequence + 1").select("network", (F.col("ledger_sequence") + 1).alias("from_sequence"), (F.col("_next") - 1).alias("to_sequence"))


def list_open_gaps(gaps: DataFrame) -> DataFrame:
    """Unresolved gaps, the newest first; healing starts at their end unless it has begun."""
    return gaps.where("resolved_at is null").withColumn("heal_next_to", F.coalesce("heal_next_to", "to_sequence")).orderBy(F.desc("to_sequence"), "id")


def record_gaps(gaps: DataFrame, found: DataFrame) -> DataFrame:
    """``gaps`` and those of ``found`` whose id is new."""
    from ..sources.sinks import new_rows

    return gaps.unionByName(new_rows(found, gaps, ["id"], ["id"]), allowMissingColumns=True)


def retention_wall(ledgers: DataFrame, lo: int, hi: int) -> DataFrame:
    """Oldest ledger from which all are there up to ``hi``; ``hi`` + 1 if ``hi`` itself is missing."""
    rows = ledgers.where(F.col("ledger_sequence").between(lo, hi))
    broken = sequence_gaps(rows).agg(F.max(F.col("to_sequence") + 1).alias("after"))
    bounds = rows.agg(F.min("ledger_sequence").alias("first"), F.max("ledger_sequence").alias("last"))
    return bounds.join(broken, F.lit(True)).select(
        F.when(F.col("last") == hi, F.coalesce("after", "first")).otherwise(F.lit(hi + 1)).cast("long").alias("wall")
    )


def network_reset(cursors: DataFrame) -> DataFrame:
    """Whether the stored cursor is too far past the network's tip to belong to it."""
    return cursors.select("network", "cursor", "tip", (F.col("cursor") > F.col("tip") + RESET).alias("reset"))


def resume_point(cursors: DataFrame) -> DataFrame:
    """Next ledger to read and the hash it must name: after the cursor, else the configured start, else the tip."""
    return cursors.select("network", F.coalesce(F.col("cursor") + 1, F.when(F.col("start") > 0, F.col("start")), F.col("tip")).alias("next"), F.when(F.col("cursor").isNotNull(), F.col("hash")).alias("expected_hash"))


def advance_cursor(cursor: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The greatest ledger of each network, with its hash."""
    both = cursor.select("network", "ledger_sequence", "hash")
    both = both if seen is None else both.unionByName(seen.select("network", "ledger_sequence", "hash"))
    return both.groupBy("network").agg(F.max("ledger_sequence").alias("ledger_sequence"), F.max_by("hash", "ledger_sequence").alias("hash"))


def prune_hash_ring(hashes: DataFrame) -> DataFrame:
    """The last hashes of each network: those no more than 1000 below its newest."""
    newest = hashes.groupBy("network").agg(F.max("ledger_sequence").alias("_top"))
    return hashes.join(newest, "network").where(F.col("ledger_sequence") >= F.col("_top") - RING).drop("_top")


def canonicalize_changes(changes: DataFrame) -> DataFrame:
    """One sorted text for each operation: a STATE row and the update or removal after it are one unit."""
    order = W.partitionBy("network", "ledger_sequence", "tx_index", "op_index").orderBy("pos_in_tx")
    rows = changes.withColumns({"_next": F.lead("change_type").over(order), "_before": F.lag("change_type").over(order), "_body": F.lead("body").over(order)})
    pair = (F.col("change_type") == "state") & F.col("_next").isin("updated", "removed")
    taken = (F.col("_before") == "state") & F.col("change_type").isin("updated", "removed")
    unit = F.when(pair, F.concat_ws("|", "change_type", "body", "_next", "_body")).otherwise(F.concat_ws("|", "change_type", "body"))
    return (
        rows.where(~F.coalesce(taken, F.lit(False)))
        .groupBy("network", "ledger_sequence", "tx_index", "op_index")
        .agg(F.array_join(F.sort_array(F.collect_list(unit)), ";").alias("canonical"))
    )


def feed_equivalence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ledgers of which two feeds disagree, with the first component that differs.

    Rows have network, ledger_sequence, tx_hash (null for what belongs to no transaction), component (sorted
    as they are compared) and canonical. All rows of a ledger, transaction and component are compared, in any order.

    A row is 128 bits of a SHA-256 over its transaction and text. Those of one feed are added, those of the other
    subtracted, before anything is shuffled: a row a component and task is. Whole numbers are added, without overflow
    below 2^31 rows a component. The salt is drawn for each comparison, so that no feed can be made to add up to
    another one, and two that differ are taken for equal once in 2^128.
    """
    key, salt = ["network", "ledger_sequence", "component"], secrets.token_hex(16)
    # the length ends the first text, so that no two pairs of texts and nulls give the same one
    tx = F.coalesce(F.concat(F.octet_length("tx_hash").cast("string"), F.lit(":"), "tx_hash"), F.lit("-"))
    text = F.coalesce(F.concat(F.lit("="), "canonical"), F.lit("-"))
    lanes = {f"_h{k}": F.conv(F.substring("_d", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)}
    rows = lambda df, sign: df.select(*key, F.sha2(F.concat(F.lit(salt), tx, text), 256).alias("_d")).select(*key, *[(x * sign).alias(h) for h, x in lanes.items()])
    sums = rows(a, 1).unionByName(rows(b, -1)).groupBy(*key).agg(*[F.sum(h).alias(h) for h in lanes])
    return sums.where(" or ".join(f"{h} <> 0" for h in lanes)).groupBy("network", "ledger_sequence").agg(F.min("component").alias("first_difference"))


def equivalence_sample(cursor: int, cadence: int = 64, size: int = 8) -> range | None:
    """Ledgers to compare: the last ``size`` up to a checkpoint one cadence back; None while there are too few."""
    if cursor < 3 * cadence:
        return None
    last = (cursor + 1) // cadence * cadence - 1 - cadence
    return range(last - size + 1, last + 1)
