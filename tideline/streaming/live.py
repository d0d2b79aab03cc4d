"""Live extraction: whatever lands marks its ledgers, and marked ledgers are derived whole, as one commit a batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions import gap_id
from ..jobs.feed import DATA_SETS, Feed, counted, heal, healed_gaps, new_rows, open_store, snapshot
from ..operators import extract, integrity
from ..sources import landing
from ..sources.landing import LedgerSet
from ..sources.store import LEDGER, Store


class ChainDiverged(RuntimeError):
    """A ledger does not name its predecessor's hash, or is missing where none may be; nothing of its batch is stored."""


@dataclass
class Live:
    """Landing folder (ledgers, transactions, raw_events, raw_changes, assets, registrations), store folder, network.

    Files of all four tables with ledgers form one stream, of which only the ledgers are read: they are *dirty*. A dirty
    ledger is derived once its own row has landed, from all that has landed of it; until then it waits, and landing
    marks it again. What lands late therefore changes its ledger however late it is, and the result does not depend on
    how files are dealt to batches. A ledger that was derived from the same rows before is left alone; one of which
    more has landed is derived anew, and its older rows are replaced in the same commit.

    Ledgers that are missing between derived ones are recorded as gaps; ``strict`` refuses such a batch instead. When
    ledgers of a gap land, the gap is healed as far as they reach, and walks that were clamped above it follow. Ledgers
    below ``start`` are left to history walks. ``raw_changes`` and ``assets`` may be missing, where nobody lands them.
    """

    spark: SparkSession
    landing: str
    store: str
    network: str
    strict: bool = False
    start_at: int = 0

    def __post_init__(self) -> None:
        self.feed = Feed(self.spark, self.landing, self.network)
        self.tables: Store = open_store(self.spark, self.store)

    def stored(self, table: str) -> DataFrame:
        return self.tables.read(table)

    def cursor(self) -> DataFrame:
        """The last ledger of each network."""
        return self.tables.read("cursors")

    def state(self, contract: str | None = None) -> DataFrame:
        return snapshot(self.tables, "state_latest", contract and (self.network, contract))

    def trustlines(self, contract: str | None = None) -> DataFrame:
        return snapshot(self.tables, "trustline_latest", contract and (self.network, contract))

    def hashes(self) -> DataFrame:
        """The hash record: the last ledgers of each network."""
        return integrity.prune_hash_ring(self.tables.read("hashes").distinct())

    def gaps(self) -> DataFrame:
        return self.tables.read("gaps")

    def walks(self) -> DataFrame:
        return self.tables.read("walks")

    def compact(self, fanout: int = 8) -> list[str]:
        """Merge commits of like size. Run it between batches."""
        return self.tables.compact(fanout)

    def _chain_holds(self, near: LedgerSet, known: DataFrame) -> None:
        """Every landed ledger of ``near`` names the hash of the one before it, and none is there with two hashes."""
        rows = self.feed.of("ledgers", near).select(*LEDGER, "hash", "previous_hash")
        forked = rows.select(*LEDGER, "hash").unionByName(known.join(near.frame, LEDGER, "left_semi")).groupBy(*LEDGER).agg(F.count_distinct("hash").alias("n")).where("n > 1").select(*LEDGER)
        broken = integrity.continuity_breaks(rows, known).select(*LEDGER).unionByName(forked).orderBy("ledger_sequence").first()
        if broken is not None:
            raise ChainDiverged(f"ledger {broken['ledger_sequence']} does not follow its predecessor")

    def process(self, batch: DataFrame, batch_id: int, stream: str | None = None) -> None:
        """Check the chain, derive the dirty ledgers of a batch (network, ledger_sequence), commit.

        A batch whose marker is written is left alone. ``stream`` names the run of batches; a streaming query's own id
        if not given, which a new checkpoint changes.
        """
        stream = stream or self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        with self.tables.pinned() as store:
            if not store.is_committed(stream, batch_id):
                self._derive(batch, batch_id, stream)

    def _derive(self, batch: DataFrame, batch_id: int, stream: str) -> None:
        store, staged = self.tables, self.tables.staged
        dirty = batch.where((F.col("network") == self.network) & (F.col("ledger_sequence") >= self.start_at)).select(*LEDGER).distinct()
        dirty = LedgerSet.of(staged(dirty, "dirty"))
        if not dirty.buckets:
            return
        around = F.explode(F.array(*[F.col("ledger_sequence") + k for k in (-1, 0, 1)])).alias("ledger_sequence")
        near = LedgerSet.of(staged(dirty.frame.select("network", around).distinct(), "near"))
        cursor = self.cursor().where(F.col("network") == self.network).first()
        known = landing.of_ledgers(store.rows("hashes"), near).select(*LEDGER, "hash").distinct()
        self._chain_holds(near, known)

        landed = self.feed.of("ledgers", dirty).select(*LEDGER, "hash")
        digests = staged(self.feed.digests(LedgerSet(landed.select(*LEDGER), dirty.buckets, dirty.first, dirty.last)), "digests")
        before = landing.of_ledgers(store.rows("derived"), dirty).groupBy(*LEDGER).agg(F.max_by("digest", "version").alias("_before"))
        changed = staged(digests.join(before, LEDGER, "left").where("_before is null or _before <> digest"), "changed")
        todo = LedgerSet.of(changed)
        again = changed.where("_before is not null").select(*LEDGER)
        replaced = None if again.isEmpty() else again.select(F.lit(None).cast("string").alias("table"), "network", F.col("ledger_sequence").alias("first"), F.col("ledger_sequence").alias("last"))

        registered = staged(self.feed.registrations(), "registrations")  # as they are now
        made, audit = self.feed.derive(todo, registered, store)
        if replaced is not None:
            made = self._with_rows_of_others(made, todo, again, registered)
        tables = new_rows(store, made, todo, again if replaced is not None else None)
        tables["hashes"] = staged(landed.join(todo.frame, LEDGER, "left_semi"), "hashes")
        tables["derived"] = changed.drop("_before")

        ends = todo.frame.agg(F.min("ledger_sequence"), F.max("ledger_sequence")).first()
        if ends[0] is not None:
            gaps = staged(self._missing(todo.frame, cursor), "gaps")
            if self.strict and not gaps.isEmpty():
                raise ChainDiverged(f"ledgers are missing around {ends[0]} to {ends[1]}")
            healed = staged(healed_gaps(self.gaps(), store.rows("derived").select(*LEDGER).unionByName(todo.frame)), "healed")
            follow = heal(store, healed)
            columns = self.gaps().columns
            added = integrity.record_gaps(self.gaps().limit(0), gaps.join(self.gaps().select("id"), "id", "left_anti"))
            tables["gaps"], tables["walks"] = added.select(*columns).unionByName(follow["gaps"].select(*columns)), follow["walks"]
            tables["cursors"] = self._cursor_after(tables["hashes"], cursor, ends[0])
        store.commit(tables, stream, batch_id, replaced, lambda: counted(audit))

    def _with_rows_of_others(self, made: dict[str, DataFrame], todo: LedgerSet, again: DataFrame, registered: DataFrame) -> dict[str, DataFrame]:
        """``made`` and, of ledgers that are derived anew, the stored rows of contracts that are not registered any more."""
        out = {}
        for name, kind in DATA_SETS.items():
            columns = self.stored(name).columns
            there = landing.of_ledgers(self.tables.rows(name), todo).join(again, LEDGER, "left_semi")
            others = there.join(extract.of_kind(registered, kind), ["network", "contract_id"], "left_anti").select(*columns)
            out[name] = made[name].unionByName(others) if name in made else others
        return out

    def _missing(self, todo: DataFrame, cursor) -> DataFrame:
        """Gaps that this batch opens: between the cursor and what lies above it, and between what lies below the first ledger and that."""
        if cursor is None:
            missing = integrity.sequence_gaps(todo)
        else:
            edge = lambda k: self.spark.createDataFrame([(self.network, k)], "network string, ledger_sequence bigint")
            above = integrity.sequence_gaps(todo.where(F.col("ledger_sequence") > cursor["ledger_sequence"]).unionByName(edge(cursor["ledger_sequence"])))
            below = integrity.sequence_gaps(todo.where(F.col("ledger_sequence") < cursor["base"]).unionByName(edge(cursor["base"])))
            missing = above.unionByName(below)
        return missing.select(
            gap_id(F.col("network"), F.col("from_sequence"), F.col("to_sequence")).alias("id"), "network", "from_sequence", "to_sequence", F.lit("not landed").alias("reason"), F.current_timestamp().alias("recorded_at")
        )

    def _cursor_after(self, hashes: DataFrame, cursor, first: int) -> DataFrame:
        now = self.cursor().where(F.col("network") == self.network)
        base = first if cursor is None else min(first, cursor["base"])
        return integrity.advance_cursor(now, hashes).withColumn("base", F.lit(base).cast("long"))

    def start(self, checkpoint: str, max_files: int = 1000) -> StreamingQuery:
        """Run over all that has landed; call again, or use another trigger, to follow the tip."""
        source = landing.stream_dirty(self.spark, self.landing, list(schemas.LANDING), max_files)
        return source.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streaming_snapshot(changes: DataFrame) -> DataFrame:
    """Latest value of each key of a stream of changes, for output mode ``update``.

    No watermark: history may arrive in any order, and the place in the chain decides.
    """
    value = F.when(F.col("change_type") != "removed", F.col("post_value"))
    latest = changes.groupBy("network", "contract_id", "key_xdr", "durability").agg(F.max_by(F.struct("ledger_sequence", "change_type", value.alias("value")), F.struct("ledger_sequence", "id")).alias("_s"))
    return latest.select(
        "network", "contract_id", "key_xdr", "durability", F.col("_s.ledger_sequence").alias("last_ledger"), F.col("_s.value").alias("value"), (F.col("_s.change_type") == "removed").alias("deleted")
    )
