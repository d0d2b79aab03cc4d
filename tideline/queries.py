"""Registered queries: each operator over whole tables."""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import snake_case
from .operators import classify, coverage, extract, history, integrity, ops, paging, snapshots
from .plans import reads, views
from .schemas import KINDS
from .sources import landing, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _indexed(s: SparkSession, d: str) -> DataFrame:
    return extract.successful_only(extract.event_index(views.raw_events(s, d)), views.transactions(s, d))


def _envelopes(s: SparkSession, d: str) -> DataFrame:
    return extract.event_envelope(extract.contract_events_only(_indexed(s, d)))


def _events(s: SparkSession, d: str) -> DataFrame:
    """Stored events: watched contracts, readable bodies."""
    return extract.watched(_envelopes(s, d).where("body_version = 0"), views.registrations(s, d), "events")


def _transfers(s: SparkSession, d: str) -> DataFrame:
    return extract.watched(extract.decoded(_envelopes(s, d)), views.registrations(s, d), "transfers")


def _movements(s: SparkSession, d: str) -> DataFrame:
    return extract.attribute_movements(views.transfers(s, d), views.movement_registrations(s, d))


def _states(s: SparkSession, d: str) -> DataFrame:
    return extract.derive_state_changes(views.state_changes(s, d), views.supplier_registrations(s, d))


def _lines(s: SparkSession, d: str) -> DataFrame:
    return extract.derive_trustline_changes(views.trustline_changes(s, d), views.assets(s, d), views.asset_registrations(s, d))


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


EVENT = ("id", "contract_id", "event_name", "topic0", "topic1", "value_b64")
MOVE = ("contract_id", "transfer_id", "role", "token_contract_id", "transfer_type", "counterparty", "amount")
TRANSFER = ("id", "contract_id", "transfer_type", "from", "to", "amount")
STATE = ("contract_id", "key_xdr", "durability", "last_ledger", "value", "deleted")
LINE = ("contract_id", "account_id", "last_ledger", "asset", "balance", "flags", "deleted")
WALK = ("contract_id", "target_from", "next_to", "done", "clamped_at", "covered_kinds")


def _kinds_text(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns or ("covered_kinds",):
        df = df.withColumn(c, F.array_join(c, ","))
    return df


@query
def S1_read_ledgers(s, d):
    top = views.ledgers(s, d)
    lo = top.agg(F.min("ledger_sequence")).first()[0]
    return landing.read_ledgers(top, lo + 1000, lo + 200_000).select("ledger_sequence", "hash")


@query
def S5_append_idempotent(s, d):
    """A batch of all changes onto a store of the even ledgers' changes."""
    rows = views.state_rows(s, d)
    key = ["network", "contract_id", "tx_hash", "change_index"]
    stored = sinks.first_per_key(rows.where("ledger_sequence % 2 = 0"), key, ["id", "key_xdr", "post_value"])
    return sinks.new_rows(rows, stored, key, ["id", "key_xdr", "post_value"]).select("id", "contract_id", "key_xdr", "change_type")


@query
def S4_static_snapshot(s, d):
    return _kinds_text(landing.static_snapshot(views.registrations(s, d), "C1"), "kinds").select("contract_id", "source", "kinds")


@query
def S7_export_page(s, d):
    closed = F.timestamp_seconds(F.col("ledger_sequence") * 86_400 + F.length("amount")).alias("closed_at")
    return sinks.export_page(views.transfers(s, d).select("id", "contract_id", closed, "transfer_type", "from", "to", "amount"))


@query
def F1_successful_only(s, d):
    return extract.successful_only(views.raw_events(s, d), views.transactions(s, d)).groupBy("ledger_sequence").agg(F.count("*").alias("n"))


@query
def F2_contract_events_only(s, d):
    return extract.contract_events_only(extract.event_index(views.raw_events(s, d))).select("ledger_sequence", "tx_index", "event_index", "contract_id")


@query
def F3_watched(s, d):
    return _shown(_events(s, d), *EVENT)


@query
def F4_any_kind(s, d):
    known = views.registrations(s, d)
    return s.createDataFrame([(k, extract.any_kind(known, k)) for k in (*KINDS, "none")], "kind string, registered boolean")


@query
def F5_ledger_bounds(s, d):
    return paging.ledger_bounds(views.state_rows(s, d), 9000, 9500).select("id", "contract_id", "key_xdr", "change_type")


@query
def F6_topic_filter(s, d):
    return paging.topic_filter(_envelopes(s, d), base64.b64encode(b"transfer").decode()).select("id", "contract_id", "topic0", "topic1")


@query
def F7_account_filter(s, d):
    return _shown(paging.account_filter(views.transfers(s, d), account="G7"), *TRANSFER)


@query
def F8_transfer_type(s, d):
    return _shown(paging.transfer_type_filter(views.transfers(s, d), "mint"), *TRANSFER)


@query
def F9_role_and_token(s, d):
    return _shown(paging.equals(paging.role_filter(_movements(s, d), "sender"), token_contract_id="C3"), *MOVE)


@query
def F10_key_and_holder(s, d):
    """Entries of a key, and lines of a holder in the same columns."""
    entries = paging.equals(snapshots.state_snapshot(views.state_rows(s, d)), key_xdr="K5").select(*STATE)
    lines = paging.equals(snapshots.trustline_snapshot(_lines(s, d)), account_id="G7")
    return entries.unionByName(lines.select("contract_id", F.col("account_id").alias("key_xdr"), F.col("asset").alias("durability"), "last_ledger", F.col("balance").cast("string").alias("value"), "deleted"))


@query
def F11_live_only(s, d):
    return snapshots.live_only(snapshots.state_snapshot(views.state_rows(s, d))).select(*STATE)


@query
def F12_keyset_after(s, d):
    return _shown(paging.keyset_after(_movements(s, d), ["contract_id", "role"], ("G4", "recipient")), *MOVE)


@query
def F13_participates_watched(s, d):
    return extract.participates_watched(_envelopes(s, d), views.registrations(s, d)).select("id", "contract_id", "event_name")


@query
def F14_movement_named(s, d):
    return extract.movement_named(_envelopes(s, d)).select("id", "contract_id", "event_name")


@query
def P1_event_index(s, d):
    return extract.event_index(views.raw_events(s, d)).select("ledger_sequence", "tx_index", "op_index", "pos_in_op", "event_index")


@query
def P2_change_index(s, d):
    """Line items of an order in the order of part and supplier, as changes of one transaction."""
    rows = views.table(s, d, "lineitem").select(F.lit("testnet").alias("network"), F.lit(1).alias("ledger_sequence"), F.col("l_orderkey").alias("tx_index"), F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_linenumber").alias("pos_in_tx"))
    return extract.change_index(rows).select(F.col("tx_index").alias("l_orderkey"), F.col("pos_in_tx.l_partkey").alias("l_partkey"), "change_index")


@query
def P3_chain_order_id(s, d):
    return views.state_rows(s, d).select("id", "ledger_sequence", "change_index")


@query
def P4_event_envelope(s, d):
    return _envelopes(s, d).select("id", "contract_id", "tx_hash", "event_index", "event_name", "topic0", "topic1", "topic2", "topic3", F.array_join("topics_b64", ",").alias("topics"), "value_b64", "raw_b64")


@query
def P5_decode_transfers(s, d):
    return extract.decoded(_envelopes(s, d)).select("id", "transfer_type", "from", "to", "amount", "asset", "to_muxed_id")


@query
def P6_decode_value(s, d):
    return extract.decode_transfers(_envelopes(s, d)).select("id", "reject_reason", F.col("amount_dec").cast("bigint").alias("amount"))


@query
def P7_muxed_id(s, d):
    return extract.decoded(_envelopes(s, d)).where("to_muxed_id is not null").select("id", "to_muxed_id")


@query
def P8_attribute_movements(s, d):
    return _shown(_movements(s, d), *MOVE)


@query
def P9_state_changes(s, d):
    return _states(s, d).select("id", "contract_id", "change_type", "key_xdr", "durability", "pre_value", "post_value")


@query
def P10_trustline_changes(s, d):
    return _lines(s, d).select("id", "contract_id", "account_id", "asset", "change_type", "pre_balance", "post_balance", "post_limit", "flags")


@query
def P11_asset_to_contract(s, d):
    rows = views.trustline_changes(s, d).select("network", F.coalesce("post.asset", "pre.asset").alias("asset"))
    return extract.asset_to_contract(rows, views.assets(s, d)).groupBy("contract_id", "asset").agg(F.count("*").alias("n"))


@query
def P12_rederive_transfers(s, d):
    """Transfers again, from stored events with the decoder as it is now."""
    return _shown(extract.decoded(_events(s, d)), *TRANSFER)


@query
def P13_snake_case(s, d):
    return views.spec_entries(s, d).select("contract_id", "name", snake_case(F.col("name")).alias("snake"))


@query
def P14_classify_contracts(s, d):
    rows = classify.classify_contracts(views.spec_entries(s, d))
    return rows.select("contract_id", "type", "wasm_hash", F.array_join("events", ",").alias("events"), "method")


@query
def P15_default_kinds(s, d):
    rows = classify.classify_contracts(views.spec_entries(s, d)).withColumn("kinds", F.lit(None).cast("array<string>"))
    return _kinds_text(classify.default_kinds(rows), "kinds").select("contract_id", "type", "kinds")


@query
def J1_pending_backfills(s, d):
    rows = history.pending_backfills(views.backfill(s, d), views.registrations(s, d))
    return rows.select("contract_id", "target_from", "next_to")


@query
def J5_new_against_stored(s, d):
    rows = views.transfers(s, d)
    return sinks.new_rows(rows, rows.where("ledger_sequence % 3 = 0"), sinks.IDEMPOTENCY["transfers"], ["id", "amount"]).select(*TRANSFER)


@query
def J6_event_with_transfer(s, d):
    both = _events(s, d).select("network", "id", "event_name").join(_transfers(s, d), ["network", "id"])
    return both.select("id", "event_name", "transfer_type", "amount")


@query
def A1_event_counts(s, d):
    return paging.event_counts_by_name(_events(s, d)).drop("network")


@query
def A2_state_entries(s, d):
    return paging.count_state_entries(snapshots.state_snapshot(views.state_rows(s, d))).drop("network")


@query
def A3_open_counts(s, d):
    open_gaps = views.gaps(s, d).where("resolved_at is null").agg(F.count("*").alias("open_gaps"))
    return open_gaps.join(history.pending_backfills(views.backfill(s, d), views.registrations(s, d)).agg(F.count("*").alias("pending_walks")), F.lit(True))


@query
def A4_state_snapshot(s, d):
    return snapshots.state_snapshot(_states(s, d)).select(*STATE)


@query
def A5_trustline_snapshot(s, d):
    return snapshots.trustline_snapshot(_lines(s, d)).select(*LINE)


@query
def A6_extraction_audit(s, d):
    return extract.extraction_audit(views.transactions(s, d), _envelopes(s, d), views.registrations(s, d)).drop("network")


@query
def A6_extraction_audit_whole(s, d):
    """All six counters; every fifth asset has no known contract."""
    registered = views.registrations(s, d).unionByName(views.asset_registrations(s, d), allowMissingColumns=True)
    known = views.assets(s, d).where("cast(substr(asset, 2) as int) % 5 <> 0")
    return extract.extraction_audit(views.transactions(s, d), _envelopes(s, d), registered, views.trustline_changes(s, d), known).drop("network")


@query
def A7_contract_summary(s, d):
    rows = _details(views.registrations(s, d), s, d)
    names = F.array_join(F.transform(F.map_entries("events_by_name"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return rows.select("contract_id", "events_total", F.coalesce(names, F.lit("")).alias("events_by_name"), "state_entries", _coverage_text())


def _details(own, s, d):
    return reads.contract_detail(own, _events(s, d), snapshots.state_snapshot(views.state_rows(s, d)), views.backfill(s, d), views.cursors(s, d))


def _coverage_text():
    show = lambda c: F.concat_ws(":", c["kind"], c["from_ledger"].cast("string"), c["to_ledger"].cast("string"), c["pending"].cast("string"), c["clamped_at"].cast("string"))
    return F.coalesce(F.array_join(F.transform("coverage", show), ","), F.lit("")).alias("coverage")


@query
def L1_page(s, d):
    shown = paging.page(views.transfers(s, d), ["id"], 50)
    return shown.select("id", "amount", "has_more")


@query
def L2_paginate_all(s, d):
    return paging.paginate_all(_movements(s, d), ["contract_id"], ["transfer_id", "role"], 5)


@query
def L2_paginate_accounts(s, d):
    """Pages in the order of accounts, which is not that of the chain."""
    rows = _lines(s, d).select("contract_id", "account_id", "ledger_sequence").groupBy("contract_id", "account_id").agg(F.max("ledger_sequence").alias("ledger_sequence"))
    return paging.paginate_all(rows, ["contract_id"], paging.ORDERS["trustlines"], 7)


@query
def L3_resume_key(s, d):
    shown = paging.page(paging.equals(_movements(s, d), contract_id="G4"), ["transfer_id", "role"], 3)
    return paging.resume_key(shown, "movements", "testnet", "G4", 3, ["transfer_id", "role"], snapshot=False, role="any")


@query
def L4_chain_order(s, d):
    rows = paging.paginate_all(views.state_rows(s, d), ["contract_id"], paging.ORDERS["state_changes"], 100)
    return rows.select("contract_id", "page", "n_rows", "last_id")


@query
def I1_continuity_breaks(s, d):
    return integrity.continuity_breaks(views.ledgers(s, d)).drop("network")


@query
def I2_sequence_gaps(s, d):
    return integrity.sequence_gaps(views.ledgers(s, d)).drop("network")


@query
def I2_sequence_gaps_bounded(s, d):
    """Missing ranges of a span that begins before the first ledger and ends after the last one."""
    rows = views.dense_ledgers(s, d).where("ledger_sequence % 5 > 1")
    last = rows.agg(F.max("ledger_sequence")).first()[0] or 0
    return integrity.sequence_gaps(rows, 0, last + 10).drop("network")


@query
def I3_record_gaps(s, d):
    """Gaps found again onto the half of them that is recorded."""
    found = views.gaps(s, d)
    return integrity.record_gaps(found.where("from_sequence % 20 = 0").withColumn("reason", F.lit("recorded")), found).select("id", "from_sequence", "to_sequence", "reason")


@query
def I4_open_gaps(s, d):
    return integrity.list_open_gaps(views.gaps(s, d)).select("id", "from_sequence", "to_sequence", "heal_next_to")


@query
def I5_retention_wall(s, d):
    top = views.ledgers(s, d)
    hi = top.agg(F.max("ledger_sequence")).first()[0]
    return integrity.retention_wall(top, hi - 100_000, hi)


@query
def I6_network_reset(s, d):
    """Each customer's number of ledgers against that of the next one, as cursor and tip."""
    rows = views.table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("cursor"), F.min("o_orderkey").alias("tip"))
    return integrity.network_reset(rows.select(F.col("o_custkey").cast("string").alias("network"), F.col("cursor") * 10, "tip").toDF("network", "cursor", "tip"))


@query
def I7_resume_point(s, d):
    rows = views.table(s, d, "customer").select(
        F.col("c_custkey").cast("string").alias("network"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") * 10).alias("cursor"), F.md5("c_name").alias("hash"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(F.lit(0)).alias("start"), (F.col("c_custkey") * 20).alias("tip"),
    )
    return integrity.resume_point(rows)


@query
def I8_advance_cursor(s, d):
    top = views.ledgers(s, d)
    return integrity.advance_cursor(top.where("ledger_sequence % 2 = 0"), top)


@query
def I9_prune_hash_ring(s, d):
    return integrity.prune_hash_ring(views.ledgers(s, d)).select("ledger_sequence", "hash")


@query
def B1_anchor(s, d):
    return history.anchor(views.cursors(s, d))


@query
def B2_plan_chunks(s, d):
    return history.plan_chunks(views.backfill(s, d)).drop("network")


@query
def B3_scan_chunk(s, d):
    """State changes of walked contracts, by chunks of 2000 days."""
    rows = views.state_rows(s, d).select("network", "contract_id", "id", "ledger_sequence")
    walks = views.supplier_registrations(s, d).select("network", "contract_id", F.lit(8500).cast("long").alias("target_from"), F.lit(9800).cast("long").alias("next_to"), F.lit(False).alias("done"))
    return history.scan_chunk(rows, history.plan_chunks(walks, 500), 500).groupBy("contract_id").agg(F.count("*").alias("n"))


@query
def B3_broken_chunks(s, d):
    """Chunks of 500 ledgers that have a hole or a break: every 611th ledger is missing, every 1009th names a wrong predecessor."""
    rows = views.dense_ledgers(s, d).where("ledger_sequence % 611 <> 0")
    before = F.md5(F.when(F.col("ledger_sequence") % 1009 == 0, F.lit("tampered")).otherwise((F.col("ledger_sequence") - 1).cast("string")))
    return history.broken_chunks(rows.withColumn("previous_hash", before), history.plan_chunks(views.backfill(s, d), 500), 500).drop("network")


@query
def B3_walk_chunks(s, d):
    """Walks after the chunks above their first hole or break, over the same ledgers."""
    rows = views.dense_ledgers(s, d).where("ledger_sequence % 611 <> 0")
    before = F.md5(F.when(F.col("ledger_sequence") % 1009 == 0, F.lit("tampered")).otherwise((F.col("ledger_sequence") - 1).cast("string")))
    walks = views.backfill(s, d)
    return _kinds_text(history.walk_chunks(views.raw_events(s, d), history.plan_chunks(walks, 500), rows.withColumn("previous_hash", before), walks, 500)[1]).select(*WALK)


@query
def B4_clamp_at_wall(s, d):
    return _kinds_text(history.clamp_at_wall(views.backfill(s, d), _wall(s))[1]).select(*WALK)


@query
def B4_clamp_gaps(s, d):
    return history.clamp_at_wall(views.backfill(s, d), _wall(s))[0].drop("network")


def _wall(s: SparkSession) -> DataFrame:
    return s.range(1).select(F.lit("testnet").alias("network"), F.lit(9000).cast("long").alias("wall"))


@query
def B5_reconcile_backfill(s, d):
    return _kinds_text(history.reconcile_backfill(views.backfill(s, d), views.requests(s, d))).select(*WALK)


@query
def B6_advance_backfill(s, d):
    walks = views.backfill(s, d)
    done = walks.where("not done").select("network", "contract_id", F.greatest(F.col("next_to") - 2000, F.col("target_from") - 1).alias("new_next_to"))
    return _kinds_text(history.advance_backfill(walks, done)).select(*WALK)


@query
def B7_advance_heal(s, d):
    gaps = views.gaps(s, d)
    healed = gaps.where("from_sequence % 20 = 0").select("id", (F.col("from_sequence") + F.col("to_sequence") % 3 - 1).alias("new_next_to"), F.timestamp_seconds(F.lit(1)).alias("healed_at"))
    return history.advance_heal(gaps, healed).select("id", "heal_next_to", F.col("resolved_at").isNotNull().alias("resolved"))


@query
def B8_unclamp(s, d):
    walks = views.backfill(s, d)
    healed = walks.where("clamped_at is not null").select("network", (F.col("clamped_at") - 1).alias("to_sequence"), F.expr("(clamped_at - 1) div 2").alias("new_next_to")).distinct()
    return _kinds_text(history.unclamp(walks, healed)).select(*WALK)


@query
def B9_upsert_registration(s, d):
    rows = views.registrations(s, d).drop("user_id").withColumn("classification", F.when(F.col("source") == "admin", "sac"))
    new = views.requests(s, d).select("network", "contract_id", F.lit("again").alias("source"), "kinds", F.lit(None).cast("string").alias("classification"), F.timestamp_seconds(F.lit(1)).alias("registered_at"))
    kept = history.unregister(history.upsert_registration(rows, new), rows.where("contract_id like '%9'"))
    return _kinds_text(kept, "kinds").select("contract_id", "source", "kinds", "classification", F.unix_seconds("registered_at").alias("registered_at"))


def _small_cursor(s: SparkSession) -> DataFrame:
    return s.range(1).select(F.lit("testnet").alias("network"), F.lit(15_000).cast("long").alias("cursor"))


@query
def C1_coverage(s, d):
    return coverage.coverage(views.registrations(s, d), views.backfill(s, d), _small_cursor(s), "state", 2000, 14_000).drop("network")


@query
def C1_coverage_without_cursor(s, d):
    """Before the first commit: every registered contract has its answer."""
    return coverage.coverage(views.registrations(s, d), views.backfill(s, d), _small_cursor(s).limit(0), "events", 1).drop("network")


@query
def C2_coverage_by_kind(s, d):
    return coverage.coverage_by_kind(views.registrations(s, d), views.backfill(s, d), _small_cursor(s)).drop("network", "derived")


@query
def C3_scan_status(s, d):
    rows = coverage.coverage(views.registrations(s, d), views.backfill(s, d), _small_cursor(s), "events", 3000, 14_000)
    u = F.expr("cast(substr(contract_id, 2) as bigint)")
    rows = rows.withColumns({"has_more": u % 5 == 0, "cursor": F.lit(15_000), "first": F.lit(3000), "last": F.when(u % 3 == 0, 0).when(u % 3 == 1, 14_000).otherwise(16_000)})
    return coverage.scan_status(rows).groupBy("status", "derived").agg(F.count("*").alias("n"))


def _feed(rows: DataFrame) -> DataFrame:
    component = F.element_at(F.array(F.lit("1_header"), F.lit("2_result"), F.lit("3_changes")), F.col("change_index") % 3 + 1)
    return rows.select("network", "ledger_sequence", "tx_hash", component.alias("component"), F.concat_ws("|", "id", "key_xdr", "post_value").alias("canonical"))


@query
def Q1_feed_equivalence(s, d):
    """Every change; some ledgers differ, some lack a component."""
    a = _feed(views.state_rows(s, d))
    b = a.where("ledger_sequence % 7 <> 0 or component <> '2_result'").withColumn("canonical", F.when(F.col("ledger_sequence") % 5 == 0, F.concat("canonical", F.lit("!"))).otherwise(F.col("canonical")))
    return integrity.feed_equivalence(a, b).drop("network")


@query
def Q1_feed_equivalence_whole(s, d):
    """Every change of every transaction; some transactions differ, some lack a component."""
    a = _feed(views.state_rows(s, d))
    b = a.where("tx_hash not like '%00' or component <> '2_result'").withColumn("canonical", F.when(F.col("tx_hash").like("00%"), F.concat("canonical", F.lit("!"))).otherwise(F.col("canonical")))
    return integrity.feed_equivalence(a, b).drop("network")


@query
def Q2_canonicalize_changes(s, d):
    rows = views.table(s, d, "lineitem").select(
        F.lit("testnet").alias("network"), F.lit(1).alias("ledger_sequence"), F.col("l_orderkey").alias("tx_index"), F.lit(0).alias("op_index"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos_in_tx"), F.col("l_partkey").cast("string").alias("body"),
        F.when(F.col("l_returnflag") == "A", "state").when(F.col("l_returnflag") == "N", "updated").otherwise("removed").alias("change_type"),
    )
    return integrity.canonicalize_changes(rows).select(F.col("tx_index").alias("l_orderkey"), F.md5("canonical").alias("canonical"))


@query
def Q3_equivalence_sample(s, d):
    top = views.dense_ledgers(s, d)
    sample = integrity.equivalence_sample(top.agg(F.max("ledger_sequence")).first()[0]) or range(1, 1)
    return landing.read_ledgers(top, sample.start, sample.stop - 1).select("ledger_sequence", "hash")


VOUCHED = ("from_ledger", "to_ledger", "pending", "clamped_at", "has_more")


def _answer(s, d, shown, registered, contract, kind, *columns, first=1, last=0, scan=True):
    rows = reads.vouched(shown, registered, views.backfill(s, d), views.cursors(s, d), contract, kind, first, last, scan)
    return rows.select(*columns, *VOUCHED, *(["status"] if scan else []))


@query
def R1_events(s, d):
    return _answer(s, d, reads.events(_events(s, d), "C1"), views.registrations(s, d), "C1", "events", *EVENT)


@query
def R2_state(s, d):
    return _answer(s, d, reads.state(snapshots.state_snapshot(_states(s, d)), "C1"), views.supplier_registrations(s, d), "C1", "state", *STATE[:5], scan=False)


@query
def R3_state_history(s, d):
    shown = reads.state_history(_states(s, d), "C1", first=8000)
    return _answer(s, d, shown, views.supplier_registrations(s, d), "C1", "state", "id", "key_xdr", "change_type", "post_value", first=8000)


@query
def R4_transfers(s, d):
    return _answer(s, d, reads.transfers(views.transfers(s, d), "C3", kind="transfer"), views.token_registrations(s, d), "C3", "transfers", *TRANSFER)


@query
def R4_transfers_of_no_one(s, d):
    """A page without rows, which says why."""
    shown = reads.transfers(views.transfers(s, d), "C4", account="nobody", first=9000, last=9500)
    return _answer(s, d, shown, views.token_registrations(s, d), "C4", "transfers", *TRANSFER, first=9000, last=9500)


@query
def R5_trustlines(s, d):
    return _answer(s, d, reads.trustlines(snapshots.trustline_snapshot(_lines(s, d)), "S3"), views.asset_registrations(s, d), "S3", "trustlines", "account_id", "asset", "balance", "flags", scan=False)


@query
def R6_trustline_history(s, d):
    shown = reads.trustline_history(_lines(s, d), "S3", last=9000)
    return _answer(s, d, shown, views.asset_registrations(s, d), "S3", "trustlines", "id", "account_id", "change_type", "post_balance", last=9000)


@query
def R7_movements(s, d):
    return _answer(s, d, reads.movements(_movements(s, d), "G4"), views.movement_registrations(s, d), "G4", "movements", *MOVE)


@query
def R8_contracts(s, d):
    return _kinds_text(reads.contracts(views.registrations(s, d)), "kinds").select("contract_id", "source", "kinds")


@query
def R9_contract_detail(s, d):
    own = views.registrations(s, d).where("contract_id = 'C1'")
    return _details(own, s, d).select("contract_id", "source", "events_total", "state_entries", _coverage_text())


@query
def M1_rate(s, d):
    return ops.rate(views.metrics(s, d)).select("metric", "labels", F.unix_seconds("window_start").alias("window_start"), F.round("rate", 6).alias("rate"))


@query
def M2_quantiles(s, d):
    return ops.quantiles(views.metrics(s, d), exact=True)


@query
def M3_increase(s, d):
    return ops.increase(views.metrics(s, d)).select("metric", "labels", F.unix_seconds("window_start").alias("window_start"), "increase")


@query
def M4_status(s, d):
    at = views.cursors(s, d).select("network", (F.col("cursor") + 1).alias("next"), "tip")
    gaps = views.gaps(s, d).where("resolved_at is null").agg(F.count("*").alias("open_gaps"))
    walks = views.backfill(s, d).where("not done").agg(F.count("*").alias("pending_walks"))
    rows = at.join(gaps, F.lit(True)).join(walks, F.lit(True)).withColumn("lag_seconds", (F.col("tip") - F.col("next")) * 5)
    return ops.status(rows)
