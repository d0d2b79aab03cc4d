"""A landing folder as a source of whole ledgers, and the derivation that all jobs share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import extract, history, integrity, snapshots
from ..sources import landing, sinks
from ..sources.landing import LedgerSet
from ..sources.store import LEDGER, Store, latest

DATA_SETS = {"events": "events", "transfers": "transfers", "movements": "movements", "state_changes": "state", "trustline_changes": "trustlines"}
#: The latest change of each key in each commit: table, source, key, value that settles ties, slot of a row.
LATEST = {
    "state_latest": ("state_changes", ["network", "contract_id", "key_xdr", "durability"], "post_value"),
    "trustline_latest": ("trustline_changes", ["network", "contract_id", "account_id"], "post_balance"),
}
#: Folders of a table of latest changes; a contract's are in one.
SLOTS = 64
#: What tells landed rows apart within a transaction.
IDENTITY = {"ledgers": ["hash"], "transactions": ["tx_index"], "raw_events": ["tx_index", "op_index", "pos_in_op"], "raw_changes": ["tx_index", "pos_in_tx"]}


def latest_changes(rows: DataFrame, table: str) -> DataFrame:
    _, key, value = LATEST[table]
    return latest(rows, key, ["ledger_sequence", "id", value])


def open_store(spark: SparkSession, root: str) -> Store:
    history = {
        "events": schemas.EVENTS, "transfers": schemas.TRANSFERS, "movements": schemas.MOVEMENTS, "state_changes": schemas.STATE_CHANGES, "trustline_changes": schemas.TRUSTLINE_CHANGES,
        "state_latest": schemas.STATE_CHANGES, "trustline_latest": schemas.TRUSTLINE_CHANGES, "hashes": schemas.HASHES, "derived": schemas.DERIVED,
    }
    keyed = {"gaps": (schemas.GAPS, ["id"]), "walks": (schemas.BACKFILL, ["network", "contract_id"]), "cursors": (schemas.CURSORS, ["network"])}
    slot = f"pmod(xxhash64(network, contract_id), {SLOTS})"
    folds = {t: ((lambda rows, t=t: latest_changes(rows, t)), slot) for t in LATEST}
    return Store(spark, root, history, keyed, folds)


def snapshot(store: Store, table: str, contract: tuple[str, str] | None = None) -> DataFrame:
    """State entries or trustlines as they are now; of one contract (network, id) from its folders alone."""
    rows = store.rows(table)
    if contract:
        rows = rows.where(F.col("bucket") == F.pmod(F.xxhash64(F.lit(contract[0]), F.lit(contract[1])), F.lit(SLOTS)))
        rows = rows.where((F.col("network") == contract[0]) & (F.col("contract_id") == contract[1]))
    fold = snapshots.state_snapshot if table == "state_latest" else snapshots.trustline_snapshot
    return fold(rows.drop("version", "bucket"))


@dataclass
class Feed:
    """Tables of one landing folder for one network. Those that nobody lands are empty."""

    spark: SparkSession
    path: str
    network: str

    def table(self, name: str) -> DataFrame:
        return landing.landed(self.spark, f"{self.path}/{name}", schemas.LANDING[name]).where(F.col("network") == self.network)

    def of(self, name: str, ledgers: LedgerSet) -> DataFrame:
        """Rows of whole ledgers; those that landed again count once."""
        return landing.of_ledgers(self.table(name), ledgers).dropDuplicates([*LEDGER, *IDENTITY[name]]).drop("bucket")

    def registrations(self) -> DataFrame:
        return landing.registration_snapshot(self.spark, f"{self.path}/registrations", self.network)

    def assets(self) -> DataFrame:
        return landing.parquet(self.spark, f"{self.path}/assets", schemas.ASSETS)

    def digests(self, ledgers: LedgerSet) -> DataFrame:
        """A digest of all that has landed of each ledger: a sum over its rows, so that their order and copies do not matter."""
        every = None
        for name in schemas.LANDING:
            rows = self.of(name, ledgers)
            columns = [c for c in rows.columns if c not in LEDGER]
            hashed = rows.select(*LEDGER, F.xxhash64(F.lit(name), *columns).cast("decimal(38,0)").alias("h"))
            every = hashed if every is None else every.unionByName(hashed)
        return every.groupBy(*LEDGER).agg(F.concat_ws(":", F.sum("h").cast("string"), F.count("*").cast("string")).alias("digest"))

    def derive(self, ledgers: LedgerSet, registered: DataFrame, store: Store, assets: DataFrame | None = None) -> tuple[dict[str, DataFrame], dict[str, Observation]]:
        """Rows of the five data sets from whole ledgers, and what the derivation leaves out, counted on the way.

        Events are indexed and decoded once, changes indexed once; both are staged, because several tables are
        written from them. A kind that nobody registered is not derived. ``assets`` are the folder's own if not given.
        """
        audit = {k: Observation() for k in ("transactions", "events", "changes")}
        transactions = self.of("transactions", ledgers).observe(
            audit["transactions"],
            F.count_if(~F.col("successful")).alias("failed_txs"),
            F.count_if(F.col("successful") & ~F.col("readable")).alias("suppressed_txs"),
        )
        transactions = store.staged(transactions, "transactions")
        kinds = {k for r in registered.select(F.array_distinct("kinds").alias("k")).distinct().collect() for k in r["k"]}  # sets of five kinds
        own = lambda kind: extract.of_kind(registered, kind).distinct().withColumn(f"_{kind}", F.lit(True))
        made: dict[str, DataFrame] = {}
        if kinds & {"events", "transfers", "movements"}:
            indexed = extract.successful_only(extract.event_index(self.of("raw_events", ledgers)), transactions)
            envelopes = extract.event_envelope(extract.contract_events_only(indexed))
            decoded = extract.decode_transfers(envelopes).select("network", "id", "transfer_type", "from", "to", "amount", "asset", "to_muxed_id", "reject_reason", F.lit(True).alias("_named"))
            foreign = extract.participates_watched(extract.movement_named(envelopes), registered).select("network", "id", F.lit(True).alias("_party"))
            rows = envelopes.drop("topics", "value").join(decoded, ["network", "id"], "left").join(foreign, ["network", "id"], "left")
            rows = rows.join(own("events"), LEDGER[:1] + ["contract_id"], "left").join(own("transfers"), LEDGER[:1] + ["contract_id"], "left")
            bad = F.col("reject_reason").isNotNull()
            rows = rows.observe(
                audit["events"],
                F.count_if(F.col("_events") & (F.col("body_version") != 0)).alias("suppressed_events"),
                F.count_if(bad & F.col("_transfers")).alias("suppressed_transfers"),
                F.count_if(bad & F.col("_transfers").isNull() & F.col("_party")).alias("foreign_undecodable"),
            )
            rows = store.staged(rows.where("_events or _named"), "events")
            good = rows.where("_named and reject_reason is null")
            made["events"] = rows.where("_events and body_version = 0")
            made["transfers"] = good.where("_transfers")
            made["movements"] = extract.attribute_movements(good, registered)
        if kinds & {"state", "trustlines"}:
            changes = store.staged(extract.successful_only(extract.change_index(self.of("raw_changes", ledgers)), transactions), "changes")
            lines = extract.attributed_trustlines(changes, self.assets() if assets is None else assets, registered).observe(audit["changes"], F.count_if(F.col("reject_reason").isNotNull()).alias("suppressed_trustlines"))
            made["state_changes"] = extract.derive_state_changes(changes, registered)
            made["trustline_changes"] = lines.where("reject_reason is null")
        columns = {t: [c.name for c in self.spark.createDataFrame([], store.history[t]).schema] for t in made}
        return {t: rows.select(*columns[t]) for t, rows in made.items()}, audit


def new_rows(store: Store, made: dict[str, DataFrame], ledgers: LedgerSet, again: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of a commit: of ``made`` what is not stored yet, and the latest change of each key.

    Stored rows are looked up in the ledgers' own buckets. Rows of the ledgers ``again`` are about to be replaced and
    count as not stored.
    """
    tables = {}
    for name, rows in made.items():
        there = landing.of_ledgers(store.rows(name), ledgers)
        there = there if again is None else there.join(again, LEDGER, "left_anti")
        tables[name] = store.staged(sinks.new_rows(rows, there, sinks.IDEMPOTENCY[name], ["transfer_id" if name == "movements" else "id"]), name)
    for table, (source, *_) in LATEST.items():
        if source in tables:
            tables[table] = latest_changes(tables[source], table)
    return tables


def healed_gaps(gaps: DataFrame, derived: DataFrame) -> DataFrame:
    """(id, network, to_sequence, new_next_to) of open gaps whose upper end has been derived, as far down as it has without a hole.

    The new watermark is the greatest ledger of the gap that is not derived: the old one, or one just below a
    derived ledger. Gaps and ledgers meet by bucket.
    """
    todo = integrity.list_open_gaps(gaps).select("id", "network", "from_sequence", "to_sequence", "heal_next_to")
    spans = todo.withColumn("bucket", F.explode(F.sequence(landing.bucket_of("from_sequence"), landing.bucket_of("heal_next_to"))))
    inside = derived.select("network", "ledger_sequence", landing.bucket_of().alias("bucket")).distinct().join(spans, ["network", "bucket"])
    inside = inside.where("ledger_sequence between from_sequence and heal_next_to").select("id", "ledger_sequence")
    edges = inside.withColumn("ledger_sequence", F.col("ledger_sequence") - 1).unionByName(todo.select("id", F.col("heal_next_to").alias("ledger_sequence")))
    left = edges.join(inside, ["id", "ledger_sequence"], "left_anti").groupBy("id").agg(F.max("ledger_sequence").alias("new_next_to"))
    return todo.join(left, "id").where("new_next_to < heal_next_to").select("id", "network", "to_sequence", "new_next_to")


def heal(store: Store, healed: DataFrame) -> dict[str, DataFrame]:
    """Rows of gaps and walks that change where gaps are healed down to ``new_next_to``: both belong into the commit that does it."""
    gaps, walks = store.read("gaps"), store.read("walks")
    moved = history.advance_heal(gaps, healed.withColumn("healed_at", F.current_timestamp())).join(healed.select("id"), "id", "left_semi")
    followed = history.unclamp(walks, healed)
    clamped = healed.select("network", (F.col("to_sequence") + 1).alias("clamped_at")).distinct()
    touched = walks.join(clamped, ["network", "clamped_at"], "left_semi").select(*history.KEY)
    return {"gaps": moved.select(*gaps.columns), "walks": followed.join(touched, history.KEY, "left_semi").select(*walks.columns)}


def counted(audit: dict[str, Observation]) -> dict[str, int]:
    """What the observations of a derivation saw; those that did not run saw nothing."""
    out = {"failed_txs": 0, "suppressed_txs": 0, "suppressed_events": 0, "suppressed_transfers": 0, "suppressed_trustlines": 0, "foreign_undecodable": 0}
    for seen in audit.values():
        if seen._jo is not None:
            out.update({k: int(v or 0) for k, v in seen.get.items()})
    return out
