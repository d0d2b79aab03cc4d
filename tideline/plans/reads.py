"""Read queries: filters, a page in chain order, and what the page can vouch for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage as cov
from ..operators import paging as p
from ..operators.snapshots import live_only


class UnknownContract(LookupError):
    """The contract is not registered, which is not the same as a page without rows."""


def known_contract(registrations: DataFrame, contract: str) -> DataFrame:
    own = registrations.where(F.col("contract_id") == contract)
    if own.isEmpty():
        raise UnknownContract(f"contract {contract} is not registered")
    return own


def vouched(
    shown: DataFrame, registrations: DataFrame, backfill: DataFrame, cursors: DataFrame, contract: str, kind: str, first: int = 1, last: int = 0, scan: bool = True
) -> DataFrame:
    """Rows of a page with the range that it can vouch for, and how its scan ended (``scan``; snapshots have none).

    A page without rows is one row that has the contract, its coverage and status alone.
    """
    own = known_contract(registrations, contract)
    more = shown.groupBy("network", "contract_id").agg(F.max("has_more").alias("has_more"))
    info = cov.coverage(own, backfill, cursors, kind, first, last).join(cursors.select("network", "cursor"), "network", "left").join(more, ["network", "contract_id"], "left")
    info = info.na.fill(0, ["cursor"])
    info = info.withColumns({"has_more": F.coalesce("has_more", F.lit(False)), "first": F.lit(first), "last": F.lit(last)})
    columns = ["network", "contract_id", "from_ledger", "to_ledger", "pending", "clamped_at", "has_more", *(["status"] if scan else [])]
    return cov.scan_status(info).select(*columns).join(shown.drop("has_more"), ["network", "contract_id"], "left")


def events(rows: DataFrame, contract: str, topics=(), first: int = 1, last: int = 0, limit: int = p.DEFAULT_LIMIT, after=None) -> DataFrame:
    found = p.topic_filter(p.ledger_bounds(p.equals(rows, contract_id=contract), first, last), *topics)
    return p.page(found, p.ORDERS["events"], limit, after)


def state(snapshot: DataFrame, contract: str, key: str | None = None, limit: int = p.DEFAULT_LIMIT, after=None) -> DataFrame:
    found = p.equals(live_only(snapshot), contract_id=contract, key_xdr=key)
    return p.page(found, p.ORDERS["state"], limit, after)


def state_history(changes: DataFrame, contract: str, key: str | None = None, first: int = 1, last: int = 0, limit: int = p.DEFAULT_LIMIT, after=None) -> DataFrame:
    found = p.ledger_bounds(p.equals(changes, contract_id=contract, key_xdr=key), first, last)
    return p.page(found, p.ORDERS["state_changes"], limit, after)


def transfers(rows: DataFrame, contract: str, account=None, sender=None, receiver=None, kind=None, first: int = 1, last: int = 0, limit: int = p.DEFAULT_LIMIT, after=None) -> DataFrame:
    found = p.account_filter(p.ledger_bounds(p.equals(rows, contract_id=contract), first, last), account, sender, receiver)
    return p.page(p.transfer_type_filter(found, kind), p.ORDERS["transfers"], limit, after)


def trustlines(snapshot: DataFrame, contract: str, account: str | None = None, limit: int = p.DEFAULT_LIMIT, after=None) -> DataFrame:
    found = p.equals(live_only(snapshot), contract_id=contract, account_id=account)
    return p.page(found, p.ORDERS["trustlines"], limit, after)


def trustline_history(changes: DataFrame, contract: str, account: str | None = None, first: int = 1, last: int = 0, limit: int = p.DEFAULT_LIMIT, after=None) -> DataFrame:
    found = p.ledger_bounds(p.equals(changes, contract_id=contract, account_id=account), first, last)
    return p.page(found, p.ORDERS["trustline_changes"], limit, after)


def movements(rows: DataFrame, contract: str, role=None, token=None, kind=None, first: int = 1, last: int = 0, limit: int = p.DEFAULT_LIMIT, after=None) -> DataFrame:
    found = p.equals(p.ledger_bounds(p.equals(rows, contract_id=contract), first, last), token_contract_id=token)
    return p.page(p.transfer_type_filter(p.role_filter(found, role), kind), p.ORDERS["movements"], limit, after)


def contracts(registrations: DataFrame) -> DataFrame:
    return registrations.orderBy("registered_at", "contract_id")


def contract_detail(registrations: DataFrame, events: DataFrame, snapshot: DataFrame, backfill: DataFrame, cursors: DataFrame) -> DataFrame:
    """Each registration with its events in all and by name, its live state entries, and the coverage of each of its kinds."""
    key = ["network", "contract_id"]
    names = p.event_counts_by_name(events)
    by_name = names.groupBy(*key).agg(F.sum("n").alias("events_total"), F.array_sort(F.collect_list(F.struct("event_name", "n"))).alias("_names"))
    states = p.count_state_entries(snapshot).withColumnRenamed("n", "state_entries")
    kinds = cov.coverage_by_kind(registrations, backfill, cursors)
    # at most one entry for each of the five kinds
    covered = kinds.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "kind", "from_ledger", "to_ledger", "pending", "clamped_at"))).alias("coverage"))
    rows = registrations.join(by_name, key, "left").join(states, key, "left").join(covered, key, "left")
    return rows.withColumn("events_by_name", F.map_from_entries("_names")).drop("_names").na.fill(0, ["events_total", "state_entries"])
