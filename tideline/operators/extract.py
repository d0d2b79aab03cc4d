"""From landed events and entry changes to derived rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chain_order_id, muxed_id_text
from ..schemas import MOVEMENT_NAMES

TX = ["network", "ledger_sequence", "tx_index"]


def successful_only(rows: DataFrame, transactions: DataFrame) -> DataFrame:
    """Rows of successful transactions."""
    good = transactions.where("successful").select(*TX)
    return rows.join(good, TX, "left_semi")


def event_index(raw: DataFrame) -> DataFrame:
    """``event_index``: place among all events of the transaction, before any filter."""
    order = W.partitionBy(*TX).orderBy("op_index", "pos_in_op")
    return raw.withColumn("event_index", F.row_number().over(order) - 1)


def change_index(raw: DataFrame) -> DataFrame:
    order = W.partitionBy(*TX).orderBy("pos_in_tx")
    return raw.withColumn("change_index", F.row_number().over(order) - 1)


def contract_events_only(raw: DataFrame) -> DataFrame:
    return raw.where("event_type = 'contract' and contract_id is not null")


def of_kind(registrations: DataFrame, kind: str) -> DataFrame:
    return registrations.where(F.array_contains("kinds", kind)).select("network", "contract_id")


def watched(rows: DataFrame, registrations: DataFrame, kind: str) -> DataFrame:
    """Rows whose contract is registered with ``kind``. Spark broadcasts the registrations while they are small."""
    return rows.join(of_kind(registrations, kind), ["network", "contract_id"], "left_semi")


def any_kind(registrations: DataFrame, kind: str) -> bool:
    """Whether anybody registered ``kind``: a whole derivation can be skipped otherwise."""
    return not of_kind(registrations, kind).isEmpty()


def event_envelope(indexed: DataFrame) -> DataFrame:
    """The canonical event row."""
    topic = lambda i: F.get("topics", F.lit(i))
    return indexed.select(
        "network",
        chain_order_id(F.col("ledger_sequence"), F.col("tx_index"), F.col("event_index")).alias("id"),
        "contract_id",
        "ledger_sequence",
        "closed_at",
        "tx_hash",
        "tx_index",
        "op_index",
        "event_index",
        F.when(topic(0)["t"] == "symbol", topic(0)["v"]).alias("event_name"),
        *[topic(i)["b64"].alias(f"topic{i}") for i in range(4)],
        F.transform("topics", lambda t: t["b64"]).alias("topics_b64"),
        F.col("value.b64").alias("value_b64"),
        "raw_b64",
        "topics",
        "value",
        "body_version",
    )


def _names_movement() -> Column:
    first = F.get("topics", F.lit(0))
    return (F.col("body_version") == 0) & (first["t"] == "symbol") & first["v"].isin(*MOVEMENT_NAMES)


def movement_named(events: DataFrame) -> DataFrame:
    """Events whose first topic is a symbol that names a token movement."""
    return events.where(_names_movement())


def _rest() -> Column:
    return F.slice("topics", 2, F.greatest(F.size("topics") - 1, F.lit(0)))


def _addresses() -> Column:
    return F.transform(F.filter(_rest(), lambda t: t["t"] == "address"), lambda t: t["v"])


def _named_contracts() -> Column:
    return F.array_distinct(F.filter(_addresses(), lambda a: F.startswith(a, F.lit("C"))))


def participates_watched(events: DataFrame, registrations: DataFrame) -> DataFrame:
    """Events that name a contract watched for movements in any topic after the first.

    The type test runs first: most events name no contract at all, and only the others are joined.
    """
    contracts = _named_contracts()
    some = events.where(F.size(contracts) > 0).select("network", "id", F.explode(contracts).alias("contract_id"))
    named = watched(some, registrations, "movements").select("network", "id").distinct()
    return events.join(named, ["network", "id"], "left_semi")


def _role_columns(name: Column, addrs: Column) -> tuple[Column, Column, Column]:
    """Sender, receiver, and whether the addresses suit the event."""
    n, first, last = F.size(addrs), F.get(addrs, F.lit(0)), F.try_element_at(addrs, F.lit(-1))
    some = n >= 1
    sender = F.when(name == "transfer", first).when(name == "burn", first).when(name == "clawback", last)
    receiver = F.when(name == "transfer", F.get(addrs, F.lit(1))).when(name == "mint", last)
    return F.when(some, sender), F.when(some, receiver), F.when(name == "transfer", n == 2).otherwise(some)


def _with_reason(movements: DataFrame) -> DataFrame:
    """Movement events with ``_amount``, ``_muxed`` and ``reject_reason``, null where they can be decoded."""
    topics, value = F.col("topics"), F.col("value")
    rest = _rest()
    suits = _role_columns(F.get(topics, F.lit(0))["v"], _addresses())[2]
    entry = lambda key: F.try_element_at(F.filter(value["map"], lambda p: p["key"]["v"] == key), F.lit(-1))["val"]
    has = lambda key: F.exists(value["map"], lambda p: p["key"]["v"] == key)
    keys_fit = F.forall(value["map"], lambda p: p["key"]["t"].isin("symbol", "string") & p["key"]["v"].isin("amount", "to_muxed_id"))
    is_map = (value["t"] == "map") & (F.coalesce(F.size(value["map"]), F.lit(0)) > 0)
    map_fits = is_map & keys_fit & has("amount")
    amount = F.when(value["t"] == "i128", value["v"]).when(
        map_fits, F.when(entry("amount")["t"] == "i128", entry("amount")["v"])
    )
    muxed = F.when(map_fits & has("to_muxed_id"), muxed_id_text(entry("to_muxed_id")))
    reason = (
        F.when(F.exists(rest, lambda t: ~t["t"].isin("address", "string")), "topic type")
        .when(~suits, "addresses")
        .when(F.col("_amount").isNull(), "value")
        .when(F.startswith(F.col("_amount"), F.lit("-")), "negative")
        .when(map_fits & has("to_muxed_id") & F.col("_muxed").isNull(), "muxed id")
    )
    return movements.withColumns({"_amount": amount, "_muxed": muxed}).withColumn("reject_reason", reason)


def decode_transfers(events: DataFrame) -> DataFrame:
    """Movement events with type, from, to, amount (exact text), asset, muxed id, and ``reject_reason``.

    Rows that cannot be decoded keep their reason and have no amount.
    """
    name = F.get("topics", F.lit(0))["v"]
    sender, receiver, _ = _role_columns(name, _addresses())
    strings = F.transform(F.filter(_rest(), lambda t: t["t"] == "string"), lambda t: t["v"])
    return (
        _with_reason(movement_named(events))
        .withColumns({"transfer_type": name, "from": sender, "to": receiver, "asset": F.try_element_at(strings, F.lit(-1))})
        .withColumn("amount", F.when(F.col("reject_reason").isNull(), F.col("_amount")))
        .withColumn("to_muxed_id", F.when(F.col("reject_reason").isNull(), F.col("_muxed")))
        .withColumn("amount_dec", F.expr("try_cast(amount as decimal(38,0))"))
        .drop("_amount", "_muxed")
    )


def decoded(events: DataFrame) -> DataFrame:
    rows = decode_transfers(events).where("reject_reason is null")
    return rows.select(
        "network", "id", "contract_id", "ledger_sequence", "closed_at", "tx_hash", "event_index", "transfer_type", "from", "to", "amount", "asset", "to_muxed_id"
    )


def attribute_movements(transfers: DataFrame, registrations: DataFrame) -> DataFrame:
    """One row for each watched side of a transfer; a transfer to oneself gives both."""
    side = lambda role, own, other: F.struct(F.lit(role).alias("role"), F.col(own).alias("owner"), F.col(other).alias("counterparty"))
    both = transfers.withColumn("_s", F.explode(F.array(side("sender", "from", "to"), side("recipient", "to", "from"))))
    rows = both.select(
        "network",
        F.col("_s.owner").alias("contract_id"),
        F.col("id").alias("transfer_id"),
        F.col("_s.role").alias("role"),
        F.col("contract_id").alias("token_contract_id"),
        "ledger_sequence",
        "transfer_type",
        F.col("_s.counterparty").alias("counterparty"),
        "amount",
        "asset",
    ).where("contract_id is not null")
    return watched(rows, registrations, "movements")


def derive_state_changes(indexed: DataFrame, registrations: DataFrame) -> DataFrame:
    """Contract-data changes of contracts watched for state."""
    side = F.coalesce("post", "pre")
    rows = indexed.where("entry_type = 'contract_data'").select(
        "network",
        chain_order_id(F.col("ledger_sequence"), F.col("tx_index"), F.col("change_index")).alias("id"),
        side["contract_id"].alias("contract_id"),
        "ledger_sequence",
        "closed_at",
        "tx_hash",
        "tx_index",
        "change_index",
        "change_type",
        side["key_b64"].alias("key_xdr"),
        side["durability"].alias("durability"),
        F.col("pre.value_b64").alias("pre_value"),
        F.when(F.col("change_type") != "removed", F.col("post.value_b64")).alias("post_value"),
    )
    return watched(rows, registrations, "state")


def asset_to_contract(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """The contract that wraps each row's asset."""
    return rows.join(assets.select("network", "asset", "contract_id"), ["network", "asset"])


def attributed_trustlines(indexed: DataFrame, assets: DataFrame, registrations: DataFrame) -> DataFrame:
    """Trustline changes with the contract of their asset and ``reject_reason``; pool shares are skipped.

    Changes of an asset that no contract is known for keep their reason and have no contract.
    """
    side = F.coalesce("post", "pre")
    rows = indexed.where("entry_type = 'trustline'").where(side.isNotNull() & (F.coalesce(side["asset_type"], F.lit("")) != "pool_share")).select(
        "network",
        chain_order_id(F.col("ledger_sequence"), F.col("tx_index"), F.col("change_index")).alias("id"),
        side["account_id"].alias("account_id"),
        side["asset"].alias("asset"),
        "ledger_sequence",
        "closed_at",
        "tx_hash",
        "tx_index",
        "change_index",
        "change_type",
        F.col("pre.balance").alias("pre_balance"),
        F.when(F.col("change_type") != "removed", F.col("post.balance")).alias("post_balance"),
        F.when(F.col("change_type") != "removed", F.col("post.limit")).alias("post_limit"),
        F.coalesce("post.flags", "pre.flags").alias("flags"),
    )
    found = rows.join(assets.select("network", "asset", "contract_id"), ["network", "asset"], "left")
    own = of_kind(registrations, "trustlines").distinct().withColumn("_own", F.lit(True))
    kept = found.join(own, ["network", "contract_id"], "left").where("contract_id is null or _own").drop("_own")
    return kept.withColumn("reject_reason", F.when(F.col("contract_id").isNull(), "asset"))


def derive_trustline_changes(indexed: DataFrame, assets: DataFrame, registrations: DataFrame) -> DataFrame:
    """Trustline changes of watched contracts, attributed to the contract of their asset; pool shares are skipped."""
    return attributed_trustlines(indexed, assets, registrations).where("reject_reason is null").drop("reject_reason")


def _left_out(events: DataFrame, registrations: DataFrame) -> DataFrame:
    """Suppressed events and transfers and foreign undecodable of each ledger that has any, in one pass over the events."""
    odd = F.col("body_version") != 0  # no movement has another version
    rows = _with_reason(events.where(odd | _names_movement())).where(odd | F.col("reject_reason").isNotNull())
    rows = rows.select("network", "ledger_sequence", "id", "contract_id", odd.alias("_odd"), F.when(~odd, _named_contracts()).alias("_named"))
    has = lambda kind: F.bool_or(F.array_contains("kinds", kind)).alias(f"_{kind}")
    known = registrations.groupBy("network", "contract_id").agg(has("events"), has("transfers"))
    rows = rows.join(known, ["network", "contract_id"], "left")
    bad, own = ~F.col("_odd"), F.coalesce("_transfers", F.lit(False))
    some = F.when(bad & ~own, F.col("_named"))  # null, and a single row, for what is not foreign
    rows = rows.select("network", "ledger_sequence", "id", (F.col("_odd") & F.col("_events")).alias("_e"), (bad & own).alias("_t"), F.explode_outer(some).alias("contract_id"))
    rows = rows.join(of_kind(registrations, "movements").distinct().withColumn("_party", F.lit(True)), ["network", "contract_id"], "left").where("_e or _t or _party")
    counts = rows.groupBy("network", "ledger_sequence", "id").agg(F.count_if("_e").alias("_e"), F.count_if("_t").alias("_t"), F.count_if("_party").alias("_p"))
    return counts.groupBy("network", "ledger_sequence").agg(
        F.sum("_e").alias("suppressed_events"), F.sum("_t").alias("suppressed_transfers"), F.count_if(F.col("_p") > 0).alias("foreign_undecodable")
    )


def extraction_audit(
    transactions: DataFrame, events: DataFrame, registrations: DataFrame, changes: DataFrame | None = None, assets: DataFrame | None = None
) -> DataFrame:
    """Counters for each ledger: failed and unreadable transactions, suppressed events and transfers, foreign undecodable.

    ``events`` are indexed envelopes of successful transactions. With ``changes`` (indexed, of successful
    transactions) and ``assets`` suppressed trustline changes are counted too, also in ledgers that
    ``transactions`` lack.
    """
    tx = transactions.groupBy("network", "ledger_sequence").agg(
        F.count_if(~F.col("successful")).alias("failed_txs"),
        F.count_if(F.col("successful") & ~F.col("readable")).alias("suppressed_txs"),
    )
    tx = tx.join(_left_out(events, registrations), ["network", "ledger_sequence"], "left")
    if changes is not None:
        lines = attributed_trustlines(changes, assets, registrations).where("reject_reason is not null")
        tx = tx.join(lines.groupBy("network", "ledger_sequence").agg(F.count("*").alias("suppressed_trustlines")), ["network", "ledger_sequence"], "full_outer")
    return tx.na.fill(0)
