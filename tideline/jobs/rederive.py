"""A range of ledgers of one table derived anew, with the decoder as it is now."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract
from ..sources import landing
from ..sources.landing import LedgerSet
from ..sources.store import LEDGER, Store
from .feed import DATA_SETS, Feed


def rederive(store: Store, feed: Feed, table: str, first: int, last: int, derive=None) -> int:
    """Replace the rows of ``table`` in ledgers ``first`` to ``last``; the version from which on readers see it.

    All ledgers of the range that have landed are derived, and the rows that they had go in the same commit. Rows of
    contracts that are not registered for the table's kind any more are kept as they are, and so are ledgers that
    are stored but have not landed here. Other tables, other ledgers and readers that have begun see no change.
    ``derive`` stands in for the feed's own derivation.
    """
    with store.pinned():
        there = landing.read_ledgers(feed.table("ledgers"), first, last).select(*LEDGER).distinct()
        ledgers = LedgerSet.of(store.staged(there, "range"))
        registered = store.staged(feed.registrations(), "registrations")
        made, _ = (derive or feed.derive)(ledgers, registered, store)
        stored = landing.read_ledgers(store.rows(table), first, last).where(F.col("network") == feed.network)
        columns = store.read(table).columns
        unwatched = stored.join(extract.of_kind(registered, DATA_SETS[table]), ["network", "contract_id"], "left_anti")
        not_landed = stored.join(ledgers.frame, LEDGER, "left_anti").join(unwatched.select(*LEDGER, "contract_id").distinct(), [*LEDGER, "contract_id"], "left_anti")
        rows = unwatched.select(*columns).unionByName(not_landed.select(*columns))
        rows = rows.unionByName(made[table].select(*columns)) if table in made else rows
        mark = feed.spark.createDataFrame([(table, feed.network, first, last)], "table string, network string, first bigint, last bigint")
        return store.commit({table: rows}, "rederive", None, mark)
