"""What an answer can vouch for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import KINDS

KEY = ["network", "contract_id"]


def _covered(rows: DataFrame, kind: Column, first: int, last: int) -> DataFrame:
    derived, walked = F.array_contains("kinds", kind), F.col("covered_kinds").isNotNull()
    known = walked & F.array_contains("covered_kinds", kind)
    start = F.when(known, F.col("next_to") + 1).otherwise(F.col("cursor"))
    end = F.least(F.col("cursor"), F.lit(last)) if last else F.col("cursor")
    zero = F.lit(0).cast("long")
    return rows.select(
        *KEY,
        kind.alias("kind"),
        derived.alias("derived"),
        F.when(derived, F.greatest(start, F.lit(first))).otherwise(zero).alias("from_ledger"),
        F.when(derived, end).otherwise(zero).alias("to_ledger"),
        (derived & walked & F.when(known, ~F.col("done")).otherwise(F.lit(True))).alias("pending"),
        F.when(derived & known, F.col("clamped_at")).alias("clamped_at"),
    )


def _walks(registrations: DataFrame, backfill: DataFrame, cursors: DataFrame) -> DataFrame:
    walks = backfill.select(*KEY, "next_to", "done", "clamped_at", "covered_kinds")
    rows = registrations.select(*KEY, "kinds").join(walks, KEY, "left").join(cursors.select("network", "cursor"), "network", "left")
    return rows.na.fill(0, ["cursor"])  # before the first commit: nothing is covered, and the answer says so


def coverage(registrations: DataFrame, backfill: DataFrame, cursors: DataFrame, kind: str, first: int = 0, last: int = 0) -> DataFrame:
    """Covered range of ``kind`` for every registered contract, within the bounds that were asked for."""
    return _covered(_walks(registrations, backfill, cursors), F.lit(kind), first, last)


def coverage_by_kind(registrations: DataFrame, backfill: DataFrame, cursors: DataFrame) -> DataFrame:
    """Coverage of every kind that is registered; ``place`` gives the kinds' fixed order."""
    order = F.array(*[F.lit(k) for k in KINDS])
    rows = _walks(registrations, backfill, cursors).withColumn("_kind", F.explode(F.array_intersect(order, F.col("kinds"))))
    return _covered(rows, F.col("_kind"), 1, 0).withColumn("place", (F.array_position(order, F.col("kind")) - 1).cast("int"))


def scan_status(rows: DataFrame) -> DataFrame:
    """``status`` from has_more, derived, from_ledger, cursor and the bounds first and last (0: open)."""
    return rows.withColumn(
        "status",
        F.when(F.col("has_more"), "HAS_MORE")
        .when(~F.col("derived"), "OLDEST_REACHED")
        .when((F.col("last") == 0) | (F.col("last") > F.col("cursor")), "WAITING_FOR_LEDGERS")
        .when(F.col("first") < F.col("from_ledger"), "OLDEST_REACHED")
        .otherwise("COMPLETE"),
    )
