"""History walks: planning, clamping at the retention wall, reconciling requests, healing gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gap_id
from .integrity import continuity_breaks, sequence_gaps

CHUNK, ANCHOR_AHEAD = 2000, 20
KEY = ["network", "contract_id"]


def anchor(cursors: DataFrame) -> DataFrame:
    """Where a new walk starts: a little ahead of the cursor, 0 where there is none."""
    return cursors.select("network", F.coalesce(F.col("cursor") + ANCHOR_AHEAD, F.lit(0)).alias("anchor"))


def pending_backfills(backfill: DataFrame, registrations: DataFrame) -> DataFrame:
    """Unfinished walks of contracts that are still registered."""
    return backfill.where(~F.col("done")).join(registrations.select(*KEY, "kinds"), KEY)


def plan_chunks(backfill: DataFrame, size: int = CHUNK) -> DataFrame:
    """Descending chunks of every unfinished walk, all at once; the last one may be short."""
    todo = backfill.where(~F.col("done") & (F.col("next_to") >= F.greatest("target_from", F.lit(1))))
    floor = F.greatest(F.col("target_from"), F.lit(1))
    tops = F.explode(F.sequence(F.col("next_to"), floor, F.lit(-size).cast("long")))
    return todo.withColumn("_floor", floor).withColumn("chunk_to", tops).select(*KEY, F.greatest("_floor", F.col("chunk_to") - size + 1).alias("chunk_from"), "chunk_to")


def scan_chunk(rows: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows of each chunk's contract and ledgers.

    Rows and chunks meet by spans of ``size`` ledgers, two of which a chunk touches at most, whatever the length of a walk.
    """
    spans = F.sequence(F.expr(f"chunk_from div {size}"), F.expr(f"chunk_to div {size}"))
    inside = F.col("ledger_sequence").between(F.col("chunk_from"), F.col("chunk_to"))
    met = rows.withColumn("_span", F.expr(f"ledger_sequence div {size}")).join(chunks.withColumn("_span", F.explode(spans)), [*KEY, "_span"])
    return met.where(inside).drop("_span", "chunk_from", "chunk_to")


def broken_chunks(ledgers: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks that must not be walked, with the first ledger that is missing or does not name its predecessor's hash.

    A chunk is whole if all its ledgers are there and each but its first, which is not held against the one before
    the chunk, follows its predecessor. Holes and breaks meet chunks by spans of ``size`` ledgers; what a chunk lacks at
    either end of all ledgers is seen from their bounds.
    """
    span = lambda c: F.expr(f"{c} div {size}")
    dealt = chunks.withColumn("_span", F.explode(F.sequence(span("chunk_from"), span("chunk_to"))))
    gaps = sequence_gaps(ledgers).withColumn("_span", F.explode(F.sequence(span("from_sequence"), span("to_sequence"))))
    holes = dealt.join(gaps, ["network", "_span"]).where("from_sequence <= chunk_to and to_sequence >= chunk_from")
    holes = holes.withColumn("ledger_sequence", F.greatest("from_sequence", "chunk_from"))
    broken = continuity_breaks(ledgers).select("network", "ledger_sequence", span("ledger_sequence").alias("_span"))
    breaks = dealt.join(broken, ["network", "_span"]).where("ledger_sequence > chunk_from and ledger_sequence <= chunk_to")
    ends = ledgers.groupBy("network").agg(F.min("ledger_sequence").alias("_lo"), F.max("ledger_sequence").alias("_hi"))
    outside = chunks.join(ends, "network", "left").where("_lo is null or chunk_from < _lo or chunk_to > _hi")
    outside = outside.withColumn("ledger_sequence", F.when(F.col("_lo").isNull() | (F.col("chunk_from") < F.col("_lo")), F.col("chunk_from")).otherwise(F.greatest(F.col("_hi") + 1, F.col("chunk_from"))))
    columns = [*KEY, "chunk_from", "chunk_to", "ledger_sequence"]
    found = holes.select(*columns).unionByName(breaks.select(*columns)).unionByName(outside.select(*columns))
    return found.groupBy(*KEY, "chunk_from", "chunk_to").agg(F.min("ledger_sequence").alias("ledger_sequence"))


def walk_chunks(rows: DataFrame, chunks: DataFrame, ledgers: DataFrame, backfill: DataFrame, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Rows of the chunks that can be walked, and the walks after them: both belong into one commit.

    A walk stops above its first broken chunk, so that what it claims to cover has no hole.
    """
    broken = broken_chunks(ledgers, chunks, size).groupBy(*KEY).agg(F.max("chunk_to").alias("_stop"))
    good = chunks.join(broken, KEY, "left").where("_stop is null or chunk_from > _stop").drop("_stop")
    progress = good.groupBy(*KEY).agg((F.min("chunk_from") - 1).alias("new_next_to"))
    return scan_chunk(rows, good, size), advance_backfill(backfill, progress)


def clamp_at_wall(backfill: DataFrame, walls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gaps for what lies below the wall, to be written first, and the walks as they are after it.

    ``walls`` has network and ``wall``, the oldest ledger that can be served.
    """
    floor = F.greatest(F.col("target_from"), F.lit(1))
    rows = backfill.join(walls, "network").withColumn("_hit", ~F.col("done") & (F.col("wall") > floor) & (F.col("next_to") >= floor))
    stop = F.least(F.col("wall") - 1, F.col("next_to"))
    gaps = rows.where("_hit").select(
        gap_id(F.col("network"), floor, stop).alias("id"), "network", floor.alias("from_sequence"), stop.alias("to_sequence"), F.lit("retention").alias("reason")
    ).distinct()
    clamp = F.least(F.col("wall"), F.col("next_to") + 1)
    walks = rows.select(
        *KEY,
        "target_from",
        F.when(F.col("_hit") & (F.col("wall") <= F.col("next_to")), F.col("wall") - 1).otherwise(F.col("next_to")).alias("next_to"),
        (F.col("done") | F.col("_hit")).alias("done"),
        F.when(F.col("_hit"), clamp).otherwise(F.col("clamped_at")).alias("clamped_at"),
        "covered_kinds",
    )
    return gaps, walks


def reconcile_backfill(current: DataFrame, requests: DataFrame) -> DataFrame:
    """Walks after requests (target_from, anchor, kinds): created, extended, reopened, narrowed or as they were."""
    wanted = requests.select(*KEY, F.col("target_from").alias("_target"), F.col("anchor").alias("_anchor"), F.col("kinds").alias("_kinds"))
    rows = current.join(wanted, KEY, "full_outer")
    absent, asked = F.col("covered_kinds").isNull(), F.col("_kinds").isNotNull()
    covered = F.array_intersect("covered_kinds", "_kinds")
    extends = F.col("_target") < F.col("target_from")
    new_kinds = F.size(F.array_except("_kinds", "covered_kinds")) > 0
    narrowed = F.size(covered) != F.size("covered_kinds")
    create, move = absent & asked, ~absent & asked & (extends | new_kinds)
    narrow = ~absent & asked & ~(extends | new_kinds) & narrowed
    return rows.select(
        *KEY,
        F.when(create, F.col("_target")).when(move, F.least("_target", "target_from")).otherwise(F.col("target_from")).alias("target_from"),
        F.when(create | (move & new_kinds), F.col("_anchor")).otherwise(F.col("next_to")).alias("next_to"),
        F.when(create, F.col("_anchor") < F.col("_target")).when(move, F.lit(False)).otherwise(F.col("done")).alias("done"),
        F.when(~(create | move), F.col("clamped_at")).alias("clamped_at"),
        F.when(create | move, F.col("_kinds")).when(narrow, covered).otherwise(F.col("covered_kinds")).alias("covered_kinds"),
    )


class WalkVanished(LookupError):
    """Progress of a contract that has been unregistered since; its chunk must not be stored."""


def advance_backfill(backfill: DataFrame, progress: DataFrame) -> DataFrame:
    """Walks after finished chunks (``new_next_to``, and ``clamped_at`` where one met the wall): done once below their target."""
    gone = progress.join(backfill.select(*KEY), KEY, "left_anti").select("contract_id").first()
    if gone is not None:
        raise WalkVanished(f"the walk of {gone[0]} is gone")
    clamp = F.col("clamped_at") if "clamped_at" in progress.columns else F.lit(None).cast("long")
    rows = backfill.join(progress.select(*KEY, "new_next_to", clamp.alias("_clamp")), KEY, "left")
    moved = F.col("new_next_to").isNotNull()
    return rows.select(
        *KEY,
        "target_from",
        F.coalesce("new_next_to", "next_to").alias("next_to"),
        F.when(moved, (F.col("new_next_to") < F.greatest("target_from", F.lit(1))) | F.col("_clamp").isNotNull()).otherwise(F.col("done")).alias("done"),
        F.coalesce("_clamp", "clamped_at").alias("clamped_at"),
        "covered_kinds",
    )


def advance_heal(gaps: DataFrame, healed: DataFrame) -> DataFrame:
    """Gaps after healing down to ``new_next_to``; resolved once that is below their start. Resolved gaps stay."""
    rows = gaps.join(healed.select("id", "new_next_to", "healed_at"), "id", "left")
    moved = F.col("new_next_to").isNotNull() & F.col("resolved_at").isNull()
    done = moved & (F.col("new_next_to") < F.col("from_sequence"))
    kept = [c for c in gaps.columns if c not in ("heal_next_to", "resolved_at")]
    return rows.select(
        *kept, F.when(moved, F.col("new_next_to")).otherwise(F.col("heal_next_to")).alias("heal_next_to"), F.when(done, F.col("healed_at")).otherwise(F.col("resolved_at")).alias("resolved_at")
    )


def unclamp(backfill: DataFrame, healed: DataFrame) -> DataFrame:
    """Walks clamped exactly above a healed gap (network, to_sequence, new_next_to) follow it down."""
    heal = healed.select("network", (F.col("to_sequence") + 1).alias("clamped_at"), "new_next_to")
    rows = backfill.join(heal, ["network", "clamped_at"], "left")
    hit, below = F.col("new_next_to").isNotNull(), F.col("target_from") <= F.col("new_next_to")
    return rows.select(
        *KEY,
        "target_from",
        F.when(hit & ~below, F.greatest("target_from", F.lit(1)) - 1).when(hit, F.least("new_next_to", "next_to")).otherwise(F.col("next_to")).alias("next_to"),
        "done",
        F.when(~(hit & ~below), F.col("clamped_at")).alias("clamped_at"),
        "covered_kinds",
    )


def upsert_registration(current: DataFrame, requests: DataFrame) -> DataFrame:
    """Registrations after requests: kinds and source replaced, classification kept if not given, first time kept."""
    new = requests.select(*KEY, *[F.col(c).alias(f"_{c}") for c in ("source", "kinds", "classification", "registered_at")])
    rows = current.join(new, KEY, "full_outer")
    return rows.select(
        *KEY,
        F.coalesce("_source", "source").alias("source"),
        F.coalesce("_kinds", "kinds").alias("kinds"),
        F.coalesce("_classification", "classification").alias("classification"),
        F.coalesce("registered_at", "_registered_at").alias("registered_at"),
    )


def unregister(current: DataFrame, contracts: DataFrame) -> DataFrame:
    """Registrations (or walks) without those of ``contracts``; derived rows stay."""
    return current.join(contracts.select(*KEY), KEY, "left_anti")
