"""What a running ingestion looks like from outside: its store held against what has landed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity, ops
from ..sources import landing
from .feed import Feed, open_store

#: Fixed value: seconds from one ledger to the next, for ledgers without a close time.
CADENCE = 5
#: State of the second feed where there is none; otherwise that of a healer.
NO_ARCHIVE = "off"


def status(spark: SparkSession, folder: str, store: str, network: str, archive: str = NO_ARCHIVE, now: datetime | None = None) -> DataFrame:
    """One row: cursor, next, tip, lag_seconds, open_gaps, pending_walks, archive, counters, tip_lag, ready and alert.

    The store is read as of one commit. ``tip`` is the newest ledger that has landed in ``folder``; of the landing only its
    newest bucket and the cursor's ledger are read. ``lag_seconds`` is the age of the cursor's ledger at ``now`` (the
    present, if not given), at the network's cadence from the tip where the ledger has no close time. Before the first
    commit the cursor is 0, nothing is ready, and the lag is null; the alert then tells of gaps alone.
    """
    feed = Feed(spark, folder, network)
    tip = landing.last_ledger(spark, f"{folder}/ledgers", network) or 0
    with open_store(spark, store).as_of_now() as tables:
        found = tables.read("cursors").where(F.col("network") == network).first()
        cursor = found["ledger_sequence"] if found else 0
        gaps = integrity.list_open_gaps(tables.read("gaps")).where(F.col("network") == network).count()
        walks = tables.read("walks").where((F.col("network") == network) & ~F.col("done")).count()
        counters = tables.counters()
    closed = landing.read_ledgers(feed.table("ledgers"), cursor, cursor).agg(F.max("closed_at").alias("closed_at"))
    counted = F.create_map(*[F.lit(x) for pair in sorted(counters.items()) for x in pair]) if counters else F.lit(None)
    rows = closed.select(
        F.lit(network).alias("network"),
        F.lit(cursor).cast("long").alias("cursor"),
        F.lit(cursor + 1).cast("long").alias("next"),
        F.lit(max(tip, cursor)).cast("long").alias("tip"),
        F.lit(gaps).cast("long").alias("open_gaps"),
        F.lit(walks).cast("long").alias("pending_walks"),
        F.lit(archive).alias("archive"),
        counted.cast("map<string,bigint>").alias("counters"),
        (F.unix_seconds(F.lit(now) if now else F.current_timestamp()) - F.unix_seconds("closed_at")).alias("_age"),
    )
    lag = F.when(F.col("cursor") > 0, F.coalesce("_age", (F.col("tip") - F.col("cursor")) * CADENCE))
    shown = ops.status(rows.withColumn("lag_seconds", lag).drop("_age"))
    return shown.withColumns({"ready": F.col("ready") & (F.col("cursor") > 0), "alert": F.coalesce("alert", F.col("open_gaps") != 0)})
