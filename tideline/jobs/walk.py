"""History walks as a job: rows, progress, walls and gaps of a step in one commit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history
from ..sources import landing
from ..sources.landing import LedgerSet
from ..sources.store import LEDGER
from .feed import DATA_SETS, Feed, counted, new_rows, open_store


@dataclass
class Walker:
    """Walks the history of registered contracts downward through a landing folder, into the store of the live job.

    A step takes the next chunks of every unfinished walk at once. A chunk counts only if each of its ledgers has
    landed and names its predecessor; a walk stops above the first chunk that does not, and tries again in a later
    step. Below the oldest ledger that has landed there is nothing to wait for: what a walk wants from there becomes a
    gap, and the walk is done, clamped at that wall. Rows, walks and gaps of a step have one marker, so that a crash
    leaves nothing half done.
    """

    spark: SparkSession
    landing: str
    store: str
    network: str
    size: int = history.CHUNK

    def __post_init__(self) -> None:
        self.feed = Feed(self.spark, self.landing, self.network)
        self.tables = open_store(self.spark, self.store)

    def walks(self) -> DataFrame:
        return self.tables.read("walks")

    def request(self, requests: DataFrame) -> None:
        """Take up requests (network, contract_id, target_from, anchor, kinds): new walks, and changes of those there are."""
        with self.tables.pinned() as store:
            walks = store.read("walks")
            after = history.reconcile_backfill(walks, requests)
            asked = requests.select(*history.KEY)
            store.commit({"walks": after.join(asked, history.KEY, "left_semi").select(*walks.columns)}, "requests")

    def run(self, chunks: int = 50) -> int:
        """Steps of ``chunks`` a walk until nothing moves any more; how many there were."""
        steps = 0
        while self.step(chunks):
            steps += 1
        return steps

    def step(self, chunks: int = 50) -> bool:
        """Walk up to ``chunks`` chunks of every unfinished walk; whether anything moved."""
        with self.tables.pinned() as store:
            registered = store.staged(self.feed.registrations(), "registrations")
            walks = store.staged(history.pending_backfills(store.read("walks"), registered).where(F.col("network") == self.network), "walks")
            plan = history.plan_chunks(walks, self.size)
            top = walks.select(*history.KEY, F.col("next_to").alias("_top"))
            plan = plan.join(top, history.KEY).where(F.col("_top") - F.col("chunk_to") < chunks * self.size).drop("_top")
            plan = store.staged(plan, "plan")
            bounds = plan.agg(F.min("chunk_from"), F.max("chunk_to")).first()
            if bounds[0] is None:
                return self._finish(walks)
            wall = landing.first_ledger(self.spark, f"{self.landing}/ledgers", self.network)
            if wall is None:
                return False
            served = plan.where(F.col("chunk_to") >= wall).withColumn("chunk_from", F.greatest("chunk_from", F.lit(wall)))
            wanted = self._ledgers_of(served)
            ledgers = store.staged(self.feed.of("ledgers", wanted), "ledgers")
            broken = history.broken_chunks(ledgers, served, self.size)
            stop = store.staged(broken.groupBy(*history.KEY).agg(F.max("chunk_to").alias("_stop")), "stop")
            good = store.staged(served.join(stop, history.KEY, "left").where("_stop is null or chunk_from > _stop").drop("_stop"), "good")

            progress = good.groupBy(*history.KEY).agg((F.min("chunk_from") - 1).alias("new_next_to"))
            current = walks.select(*self._columns(walks))
            after = history.advance_backfill(current, progress)
            # a walk meets the wall once all above it is walked
            lowest = plan.groupBy(*history.KEY).agg(F.min("chunk_from").alias("_low")).where(F.col("_low") < wall)
            met = after.join(lowest.join(stop, history.KEY, "left_anti"), history.KEY, "left_semi")
            gaps, clamped = history.clamp_at_wall(met, self.spark.createDataFrame([(self.network, wall)], "network string, wall bigint"))
            after = after.join(met.select(*history.KEY), history.KEY, "left_anti").unionByName(clamped)
            moved = store.staged(after.exceptAll(current), "moved")
            if moved.isEmpty():
                return False

            own = registered.join(good.select(*history.KEY).distinct(), history.KEY, "left_semi")
            made, audit = self.feed.derive(self._ledgers_of(good), own, store)
            made = {name: history.scan_chunk(rows, good, self.size).select(*rows.columns) for name, rows in made.items() if name in DATA_SETS}
            tables = new_rows(store, made, self._ledgers_of(good))
            there = store.read("gaps")
            gaps = gaps.withColumn("recorded_at", F.current_timestamp()).join(there.select("id"), "id", "left_anti")
            tables["gaps"] = there.limit(0).unionByName(gaps, allowMissingColumns=True)
            tables["walks"] = moved
            store.commit(tables, "walk", None, None, lambda: counted(audit))
            return True

    def _columns(self, walks: DataFrame) -> list[str]:
        return [c for c in walks.columns if c != "kinds"]

    def _finish(self, walks: DataFrame) -> bool:
        """Walks with nothing left to walk are done."""
        over = walks.where(F.col("next_to") < F.greatest("target_from", F.lit(1))).withColumn("done", F.lit(True))
        if over.isEmpty():
            return False
        self.tables.commit({"walks": over.select(*self._columns(walks))}, "walk")
        return True

    def _ledgers_of(self, chunks: DataFrame) -> LedgerSet:
        """The ledgers of chunks, each once however many walks want it."""
        ledgers = chunks.select("network", "chunk_from", "chunk_to").distinct().select("network", F.explode(F.sequence("chunk_from", "chunk_to")).alias("ledger_sequence"))
        return LedgerSet.of(self.tables.staged(ledgers.select(*LEDGER).distinct(), "wanted"))
