"""Healing of gaps from a second feed, behind a gate that compares the two."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, integrity
from ..sources.landing import LedgerSet
from ..sources.store import LEDGER
from .feed import Feed, counted, heal, new_rows, open_store

UNVERIFIED, VERIFIED, FAILED = "unverified", "verified", "equivalence failed"


def components(feed: Feed, ledgers: LedgerSet) -> DataFrame:
    """What two feeds of a ledger are compared by: header, results, events and entry changes of each transaction.

    Diagnostic events are left out, and changes of an operation are put in canonical order: both differ between runs.
    """
    of = lambda rows, component, tx, text: rows.select(*LEDGER, tx.alias("tx_hash"), F.lit(component).alias("component"), text.alias("canonical"))
    text = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    none = F.lit(None).cast("string")
    header = of(feed.of("ledgers", ledgers), "1_header", none, text("hash", "previous_hash", "closed_at"))
    results = of(feed.of("transactions", ledgers), "2_result", F.col("tx_hash"), text("tx_index", "successful", "readable"))
    raw = feed.of("raw_events", ledgers).where("event_type <> 'diagnostic'")
    events = of(raw, "3_events", F.col("tx_hash"), text("tx_index", "op_index", "pos_in_op", "event_type", "contract_id", "body_version", "topics", "value", "raw_b64"))
    changes = feed.of("raw_changes", ledgers).withColumn("body", text("tx_hash", "entry_type", "pre", "post"))
    units = integrity.canonicalize_changes(changes)
    units = of(units, "4_changes", F.concat_ws(":", "tx_index", "op_index"), F.col("canonical"))
    return header.unionByName(results).unionByName(events).unionByName(units)


@dataclass
class Healer:
    """Fills open gaps of a store from ``archive``, a landing folder that has what ``landing`` lacks.

    Before the first gap, a few recent ledgers that both folders have are compared. If they differ, or one has not all of
    them, this healer does nothing from then on: a declared gap is better than rows that nobody can vouch for. A step
    takes one chunk of each gap, downward from its end; a chunk that is not whole in the archive waits. Rows, gaps and
    the walks that were clamped above them are one commit.
    """

    spark: SparkSession
    archive: str
    landing: str
    store: str
    network: str
    size: int = history.CHUNK
    state: str = UNVERIFIED

    def __post_init__(self) -> None:
        self.replay = Feed(self.spark, self.archive, self.network)
        self.primary = Feed(self.spark, self.landing, self.network)
        self.tables = open_store(self.spark, self.store)

    def verify(self) -> str:
        """Compare the sample; the state after it."""
        row = self.tables.read("cursors").where(F.col("network") == self.network).first()
        sample = integrity.equivalence_sample(row["ledger_sequence"]) if row else None
        if sample is None:
            self.state = FAILED
            return self.state
        named = LedgerSet.of(self.spark.createDataFrame([(self.network, k) for k in sample], "network string, ledger_sequence bigint"))
        both = [feed.of("ledgers", named).select("ledger_sequence").distinct().count() for feed in (self.replay, self.primary)]
        differ = integrity.feed_equivalence(components(self.replay, named), components(self.primary, named))
        self.state = VERIFIED if both == [len(sample)] * 2 and differ.isEmpty() else FAILED
        return self.state

    def run(self) -> int:
        """Steps until nothing moves any more; how many there were."""
        steps = 0
        while self.step():
            steps += 1
        return steps

    def step(self) -> bool:
        """Heal a chunk of every open gap; whether anything moved."""
        with self.tables.pinned() as store:
            gaps = store.staged(integrity.list_open_gaps(store.read("gaps")).where(F.col("network") == self.network), "gaps")
            if self.state == FAILED or gaps.isEmpty():
                return False
            if self.state == UNVERIFIED and self.verify() == FAILED:
                return False
            low = F.greatest(F.col("from_sequence"), F.col("heal_next_to") - self.size + 1)
            plan = gaps.select("network", F.col("id").alias("contract_id"), low.alias("chunk_from"), F.col("heal_next_to").alias("chunk_to"))
            wanted = self._ledgers_of(plan)
            broken = history.broken_chunks(self.replay.of("ledgers", wanted), plan, self.size)
            good = store.staged(plan.join(broken.select(*history.KEY), history.KEY, "left_anti"), "good")
            if good.isEmpty():
                return False
            ledgers = self._ledgers_of(good)
            registered = store.staged(self.primary.registrations(), "registrations")
            made, audit = self.replay.derive(ledgers, registered, store, self.primary.assets())
            tables = new_rows(store, made, ledgers)
            healed = good.select(F.col("contract_id").alias("id"), "network", (F.col("chunk_from") - 1).alias("new_next_to")).join(gaps.select("id", "to_sequence"), "id")
            tables |= heal(store, store.staged(healed, "healed"))
            tables["hashes"] = self.replay.of("ledgers", ledgers).select(*LEDGER, "hash")
            tables["derived"] = self.replay.digests(ledgers)
            store.commit(tables, "heal", None, None, lambda: counted(audit))
            return True

    def _ledgers_of(self, chunks: DataFrame) -> LedgerSet:
        ledgers = chunks.select("network", F.explode(F.sequence("chunk_from", "chunk_to")).alias("ledger_sequence")).distinct()
        return LedgerSet.of(self.tables.staged(ledgers, "wanted"))
