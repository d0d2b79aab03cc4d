"""Idempotent appends and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rfc3339

#: The columns on which a derived row is stored once.
IDEMPOTENCY = {
    "events": ["network", "contract_id", "tx_hash", "event_index"],
    "state_changes": ["network", "contract_id", "tx_hash", "change_index"],
    "transfers": ["network", "contract_id", "tx_hash", "event_index"],
    "trustline_changes": ["network", "contract_id", "tx_hash", "change_index"],
    "movements": ["network", "contract_id", "transfer_id", "role"],
}


def first_per_key(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, as in an insert that does nothing on conflict."""
    rest = [c for c in batch.columns if c not in key]
    first = batch.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in batch.columns])


def new_rows(batch: DataFrame, stored: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key is not stored yet, one for each key."""
    return first_per_key(batch, key, order).join(stored.select(*key), key, "left_anti")


def id_collisions(stored: DataFrame, table: str) -> DataFrame:
    """Ids that stand for several idempotency keys; always empty."""
    key = IDEMPOTENCY[table]
    return stored.groupBy("network", "id").agg(F.count_distinct(F.struct(*key)).alias("n")).where("n > 1")


def export_page(rows: DataFrame) -> DataFrame:
    """Rows as response text: times in RFC 3339 UTC, amounts as text, empty fields left out."""
    columns = []
    for f in rows.schema.fields:
        c = F.col(f.name)
        kind = f.dataType.simpleString()
        if kind.startswith("timestamp"):
            c = rfc3339(c)
        elif kind == "string":
            c = F.when(c != "", c)
        elif kind.startswith("decimal"):
            c = c.cast("string")
        columns.append(c.alias(f.name))
    return rows.select(F.to_json(F.struct(*columns)).alias("record"))
