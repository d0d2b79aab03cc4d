"""Latest value of each key, whatever the order in which changes arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _latest(changes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    # later ledgers win, then later places in the ledger; the values settle ties of repeated ids
    found = changes.groupBy(*keys).agg(
        F.max_by(F.struct("change_type", "ledger_sequence", *values), F.struct("ledger_sequence", "id", *values)).alias("_s")
    )
    return found.select(*keys, F.col("_s.ledger_sequence").alias("last_ledger"), *[F.col(f"_s.{v}").alias(v) for v in values], (F.col("_s.change_type") == "removed").alias("deleted"))


def state_snapshot(changes: DataFrame) -> DataFrame:
    """Current entry of each (contract, key, durability); a removal leaves a tombstone without a value."""
    rows = changes.withColumn("value", F.when(F.col("change_type") != "removed", F.col("post_value")))
    return _latest(rows, ["network", "contract_id", "key_xdr", "durability"], ["value"])


def trustline_snapshot(changes: DataFrame) -> DataFrame:
    """Current line of each (contract, account)."""
    rows = changes.withColumn("balance", F.when(F.col("change_type") != "removed", F.col("post_balance")))
    return _latest(rows, ["network", "contract_id", "account_id"], ["asset", "balance", "post_limit", "flags"])


def live_only(snapshot: DataFrame) -> DataFrame:
    return snapshot.where(~F.col("deleted"))
