"""Landing tables as deterministic projections of the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chain_order_id

NETWORK = "testnet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seq(ts: str = "ts") -> Column:
    return F.expr(f"unix_micros(cast({ts} as timestamp)) div 5000000")


def _cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def _prefixed(letter: str, value: Column) -> Column:
    return F.concat(F.lit(letter), value.cast("string"))


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger for every five seconds with an event; every 97th names a wrong predecessor."""
    seqs = table(spark, sf_dir, "events").select(_seq().alias("ledger_sequence")).distinct()
    before = F.md5((F.col("ledger_sequence") - 1).cast("string"))
    return seqs.select(
        F.lit(NETWORK).alias("network"),
        "ledger_sequence",
        F.md5(F.col("ledger_sequence").cast("string")).alias("hash"),
        F.when(F.col("ledger_sequence") % 97 == 0, F.md5(F.lit("tampered"))).otherwise(before).alias("previous_hash"),
        F.timestamp_seconds(F.col("ledger_sequence") * 5).alias("closed_at"),
    )


def _placed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("ledger_sequence").orderBy("event_id")) - 1
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", _cents("value").alias("cents"), _seq().alias("ledger_sequence"))
    return rows.withColumn("_r", rank).withColumn("tx_index", (F.expr("_r div 3") + 1).cast("int"))


def _successful() -> Column:
    return (F.col("ledger_sequence") + F.col("tx_index")) % 11 != 0


def _tx_hash() -> Column:
    return F.md5(F.concat_ws(":", F.col("ledger_sequence").cast("string"), F.col("tx_index").cast("string")))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _placed_events(spark, sf_dir).select("ledger_sequence", "tx_index").distinct()
    return rows.select(
        F.lit(NETWORK).alias("network"),
        "ledger_sequence",
        F.timestamp_seconds(F.col("ledger_sequence") * 5).alias("closed_at"),
        "tx_index",
        _tx_hash().alias("tx_hash"),
        _successful().alias("successful"),
        ((F.col("ledger_sequence") + F.col("tx_index")) % 17 != 0).alias("readable"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events a transaction; views, clicks, purchases and sign-ups are token movements, errors diagnostics."""
    names = F.create_map(*[F.lit(x) for x in ("view", "transfer", "click", "mint", "purchase", "burn", "signup", "clawback", "error", "error")])
    rows = _placed_events(spark, sf_dir).withColumn("_name", F.element_at(names, F.col("event_type")))  # once a row
    e, name = F.col("event_id"), F.col("_name")
    b64 = lambda v: F.base64(F.encode(v, "UTF-8"))
    tagged = lambda t, v: F.struct(F.lit(t).alias("t"), v.alias("v"), b64(v).alias("b64"))
    pair = lambda k, t, v: F.struct(F.struct(F.lit("symbol").alias("t"), F.lit(k).alias("v")).alias("key"), F.struct(F.lit(t).alias("t"), v.alias("v")).alias("val"))
    own, other = _prefixed("G", F.col("user_id")), _prefixed("C", (F.col("user_id") * 7 + e) % 1000)
    symbol, a, b = tagged("symbol", name), tagged("address", own), tagged("address", other)
    asset = tagged("string", F.when(e % 4 == 0, F.lit("native")).otherwise(F.lit("USD:G1")))
    topics = (
        F.when(name == "transfer", F.when(e % 10 == 3, F.array(symbol, a)).otherwise(F.array(symbol, a, b, asset)))
        .when(name == "mint", F.when(e % 2 == 0, F.array(symbol, a, b, asset)).otherwise(F.array(symbol, b, asset)))
        .when(name == "burn", F.array(symbol, a, asset))
        .when(name == "clawback", F.array(symbol, a, b, asset))
        .otherwise(F.array(symbol))
    )
    text = F.when(e % 13 == 0, F.concat(F.lit("-"), (F.col("cents") + 1).cast("string"))).otherwise(F.col("cents").cast("string"))
    entries = F.when(e % 25 == 1, F.array(pair("amount", "i128", text), pair("memo", "u64", e.cast("string")))).otherwise(
        F.array(pair("amount", "i128", text), pair("to_muxed_id", "u64", e.cast("string")))
    )
    in_map = (e % 5).isin(0, 1)
    value = F.struct(
        F.when(in_map, "map").otherwise("i128").alias("t"), F.when(~in_map, text).alias("v"), F.when(in_map, entries).alias("map"), b64(text).alias("b64")
    )
    return rows.select(
        F.lit(NETWORK).alias("network"),
        "ledger_sequence",
        F.timestamp_seconds(F.col("ledger_sequence") * 5).alias("closed_at"),
        "tx_index",
        _tx_hash().alias("tx_hash"),
        F.expr("cast((_r % 3) div 2 as int)").alias("op_index"),
        F.expr("cast((_r % 3) % 2 as int)").alias("pos_in_op"),
        F.when(name == "error", "diagnostic").otherwise("contract").alias("event_type"),
        _prefixed("C", F.col("user_id")).alias("contract_id"),
        F.when(e % 50 == 0, 1).otherwise(0).alias("body_version"),
        topics.alias("topics"),
        value.alias("value"),
        b64(F.concat(F.lit("e"), e.cast("string"))).alias("raw_b64"),
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two users of three are watched contracts, with one of four sets of kinds."""
    ids = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 3 <> 0")
    kinds = [["events", "transfers", "movements"], ["events"], ["events", "state", "trustlines"], ["state", "transfers", "movements"]]
    chosen = F.element_at(F.array(*[F.array(*[F.lit(k) for k in own]) for own in kinds]), (F.col("user_id") % 4 + 1).cast("int"))
    return ids.select(
        F.lit(NETWORK).alias("network"),
        _prefixed("C", F.col("user_id")).alias("contract_id"),
        F.when(F.col("user_id") % 2 == 0, "admin").otherwise("config").alias("source"),
        chosen.alias("kinds"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("user_id") % 50).alias("registered_at"),
        "user_id",
    )


def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk for most registrations, in ledgers 1 to 20,000."""
    u = F.col("user_id")
    target, next_to = u % 7 * 500 + 1, u * 37 % 20_000
    rows = registrations(spark, sf_dir).where(u % 5 != 0)
    covered = F.when(u % 8 == 1, F.slice("kinds", 1, 1)).otherwise(F.col("kinds"))
    return rows.select(
        "network", "contract_id", target.alias("target_from"), next_to.alias("next_to"), (next_to < target).alias("done"),
        F.when(u % 6 == 1, next_to + 1).alias("clamped_at"), covered.alias("covered_kinds"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh requests for a part of the registrations, some older, some with other kinds."""
    u = F.col("user_id")
    kinds = F.when(u % 10 == 1, F.array_append("kinds", "trustlines")).when(u % 10 == 2, F.slice("kinds", 1, 1)).otherwise(F.col("kinds"))
    rows = registrations(spark, sf_dir).where(u % 2 == 1)
    return rows.select("network", "contract_id", (u % 5 * 400 + 1).alias("target_from"), F.lit(25_000).cast("long").alias("anchor"), F.array_distinct(kinds).alias("kinds"))


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ledgers(spark, sf_dir).groupBy("network").agg(F.max("ledger_sequence").alias("cursor"), F.max_by("hash", "ledger_sequence").alias("hash"))
    return top.select("network", "cursor", "hash", (F.col("cursor") + 4).alias("tip"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap for each part key and line number of large orders, a third of them resolved."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").distinct()
    o = F.col("o_orderkey")
    first, last = o * 10, o * 10 + o % 9
    return rows.select(
        F.concat_ws(":", F.lit("gap"), F.lit(NETWORK), first.cast("string"), last.cast("string")).alias("id"), F.lit(NETWORK).alias("network"), first.alias("from_sequence"),
        last.alias("to_sequence"), F.lit("retention").alias("reason"), F.when(F.col("o_orderstatus") == "P", F.timestamp_seconds(o)).alias("resolved_at"),
        F.when(o % 4 == 0, last - 1).alias("heal_next_to"),
    ).dropDuplicates(["id"])


def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed contract-data changes, from line items."""
    rows = table(spark, sf_dir, "lineitem")
    value = F.base64(F.encode(_cents("l_extendedprice").cast("string"), "UTF-8"))
    null = F.lit(None)
    side = F.struct(
        _prefixed("C", F.col("l_suppkey")).alias("contract_id"), _prefixed("K", F.col("l_partkey")).alias("key_b64"), value.alias("value_b64"),
        F.when(F.col("l_linestatus") == "O", "persistent").otherwise("temporary").alias("durability"), null.cast("string").alias("account_id"),
        null.cast("string").alias("asset"), null.cast("string").alias("asset_type"), null.cast("bigint").alias("balance"), null.cast("bigint").alias("limit"), null.cast("bigint").alias("flags"),
    )
    change = F.when(F.col("l_returnflag") == "A", "created").when(F.col("l_returnflag") == "N", "updated").otherwise("removed")
    return rows.select(
        F.lit(NETWORK).alias("network"), F.expr("unix_date(cast(l_shipdate as date))").cast("long").alias("ledger_sequence"), F.col("l_shipdate").cast("timestamp").alias("closed_at"),
        F.col("l_orderkey").cast("int").alias("tx_index"), F.md5(F.col("l_orderkey").cast("string")).alias("tx_hash"), F.col("l_linenumber").alias("change_index"), F.lit("contract_data").alias("entry_type"),
        change.alias("change_type"), F.when(change != "created", side).alias("pre"), F.when(change != "removed", side).alias("post"),
    )


def state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State changes of all contracts, as derived rows."""
    side = F.coalesce("post", "pre")
    return state_changes(spark, sf_dir).select(
        "network", chain_order_id(F.col("ledger_sequence"), F.col("tx_index"), F.col("change_index")).alias("id"), side["contract_id"].alias("contract_id"), "ledger_sequence", "closed_at",
        "tx_hash", "change_index", "change_type", side["key_b64"].alias("key_xdr"), side["durability"].alias("durability"), F.col("post.value_b64").alias("post_value"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    return rows.select(F.lit(NETWORK).alias("network"), _prefixed("A", F.col("n_nationkey")).alias("asset"), _prefixed("S", F.col("n_nationkey")).alias("contract_id"))


def trustline_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed trustline changes, from orders of customers."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    null = F.lit(None)
    change = F.when(F.col("o_orderstatus") == "O", "created").when(F.col("o_orderstatus") == "F", "updated").otherwise("removed")
    side = lambda balance: F.struct(
        null.cast("string").alias("contract_id"), null.cast("string").alias("key_b64"), null.cast("string").alias("value_b64"), null.cast("string").alias("durability"),
        _prefixed("G", F.col("o_custkey")).alias("account_id"), _prefixed("A", F.col("c_nationkey")).alias("asset"),
        F.when(F.col("o_orderkey") % 19 == 0, "pool_share").otherwise("credit").alias("asset_type"), balance.alias("balance"), F.lit(10**12).cast("bigint").alias("limit"), (F.col("o_orderkey") % 4).alias("flags"),
    )
    cents = _cents("o_totalprice")
    return rows.select(
        F.lit(NETWORK).alias("network"), F.expr("unix_date(cast(o_orderdate as date))").cast("long").alias("ledger_sequence"), F.col("o_orderdate").cast("timestamp").alias("closed_at"),
        F.col("o_orderkey").cast("int").alias("tx_index"), F.md5(F.col("o_orderkey").cast("string")).alias("tx_hash"), F.lit(0).alias("change_index"), F.lit("trustline").alias("entry_type"),
        change.alias("change_type"), F.when(change != "created", side(cents - 1)).alias("pre"), F.when(change != "removed", side(cents)).alias("post"),
    )


def asset_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assets(spark, sf_dir)
    return rows.select("network", "contract_id", F.array(F.lit("trustlines")).alias("kinds"))


def supplier_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0")
    return rows.select(F.lit(NETWORK).alias("network"), _prefixed("C", F.col("s_suppkey")).alias("contract_id"), F.array(F.lit("state")).alias("kinds"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived transfers, from orders."""
    rows = table(spark, sf_dir, "orders")
    o = F.col("o_orderkey")
    day = F.expr("unix_date(cast(o_orderdate as date))").cast("long")
    kind = F.when(F.col("o_orderstatus") == "F", "transfer").when(F.col("o_orderstatus") == "O", "mint").otherwise("burn")
    return rows.select(
        F.lit(NETWORK).alias("network"), chain_order_id(day, o, F.lit(0)).alias("id"), _prefixed("C", F.col("o_custkey") % 25).alias("contract_id"), day.alias("ledger_sequence"),
        F.md5(o.cast("string")).alias("tx_hash"), F.lit(0).alias("event_index"), kind.alias("transfer_type"), F.when(kind != "mint", _prefixed("G", F.col("o_custkey"))).alias("from"),
        F.when(kind != "burn", _prefixed("G", o % 1500)).alias("to"), _cents("o_totalprice").cast("string").alias("amount"), F.lit("native").alias("asset"),
    )


def token_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("_t")).distinct()
    return rows.select(F.lit(NETWORK).alias("network"), _prefixed("C", F.col("_t")).alias("contract_id"), F.array(F.lit("transfers")).alias("kinds"))


def dense_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger for each order."""
    seqs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("ledger_sequence")).distinct()
    return seqs.select(F.lit(NETWORK).alias("network"), "ledger_sequence", F.md5(F.col("ledger_sequence").cast("string")).alias("hash"))


def movement_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    return rows.select(F.lit(NETWORK).alias("network"), _prefixed("G", F.col("c_custkey")).alias("contract_id"), F.array(F.lit("movements")).alias("kinds"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter samples that fall back to nothing every 500 events."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric"), F.concat(F.lit("shard="), (F.col("event_id") % 3).cast("string")).alias("labels"), (F.col("event_id") % 500).alias("value"))


def spec_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specification entries of contracts, from parts and line items."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    wasm = s % 4 != 0
    return rows.select(
        F.lit(NETWORK).alias("network"), _prefixed("C", s).alias("contract_id"), F.when(s % 4 == 0, "sac").when(s % 4 == 3, "other").otherwise("wasm").alias("executable_type"),
        F.when(wasm, F.md5(s.cast("string"))).alias("wasm_hash"), F.when((s % 4 == 1) & (p % 2 == 0), "event").otherwise("function").alias("entry_kind"),
        F.concat(F.lit("NFTMinted"), p.cast("string"), F.lit("ByOwner")).alias("name"), p.alias("ordinal"), (p % 3 != 0).alias("readable"),
    )
