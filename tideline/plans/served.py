"""Pages of a store, as a service would answer them: rows, what they can vouch for, and the key that goes on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs.feed import Feed, open_store, snapshot
from ..operators import paging
from ..sources import landing
from ..sources.store import Store
from . import reads


@dataclass(frozen=True)
class Endpoint:
    """Table that is read, data set that vouches for it, and filters; a snapshot has no ledgers to scan."""

    table: str
    kind: str
    ask: Callable[..., DataFrame]
    filters: tuple[str, ...]
    snapshot: bool = False


def _events(rows: DataFrame, contract: str, topic0=None, topic1=None, topic2=None, topic3=None, **more) -> DataFrame:
    return reads.events(rows, contract, (topic0, topic1, topic2, topic3), **more)


ENDPOINTS = {
    "events": Endpoint("events", "events", _events, ("topic0", "topic1", "topic2", "topic3")),
    "state": Endpoint("state_latest", "state", reads.state, ("key",), True),
    "state_changes": Endpoint("state_changes", "state", reads.state_history, ("key",)),
    "transfers": Endpoint("transfers", "transfers", reads.transfers, ("account", "sender", "receiver", "kind")),
    "trustlines": Endpoint("trustline_latest", "trustlines", reads.trustlines, ("account",), True),
    "trustline_changes": Endpoint("trustline_changes", "trustlines", reads.trustline_history, ("account",)),
    "movements": Endpoint("movements", "movements", reads.movements, ("role", "token", "kind")),
}
#: Buckets of ledgers that a page opens first, and how many times as many each time they do not fill it.
OPENED, MORE = 4, 4


@dataclass(frozen=True)
class Answer:
    """Rows as :func:`reads.vouched` gives them, and the resume key; null where nothing follows."""

    rows: DataFrame
    resume_key: str | None


@dataclass
class Reader:
    """Reads what the jobs have stored for the registrations of a landing folder. Holds no lock and writes nothing."""

    spark: SparkSession
    landing: str
    store: str
    network: str

    def ask(self, endpoint: str, contract: str, limit: int = paging.DEFAULT_LIMIT, first: int = 1, last: int = 0, resume: str | None = None, **filters: str | None) -> Answer:
        """The next page of a contract. With ``resume``, limit, bounds and filters are those of the key.

        The page, its coverage and its cursor are of one commit. A scan without rows keeps its key, for later ledgers.
        """
        spec, keys, after = ENDPOINTS[endpoint], paging.ORDERS[endpoint], None
        if resume is not None:
            limit, after, filters = paging.read_resume_key(resume, endpoint, self.network, contract, keys)
            first, last = filters.pop("from_ledger", 1), filters.pop("to_ledger", 0)
            if not all(isinstance(v, int) for v in (first, last)) or not all(isinstance(v, str) for v in (*after, *filters.values())):
                raise ValueError("the resume key is not valid")
        filters = {k: v for k, v in filters.items() if v is not None}
        if not set(filters) <= set(spec.filters):
            raise ValueError(f"{endpoint} has the filters {', '.join(spec.filters)}")
        with open_store(self.spark, self.store).as_of_now() as store:
            own = reads.known_contract(Feed(self.spark, self.landing, self.network).registrations(), contract)
            cursors = store.read("cursors").select("network", F.col("ledger_sequence").alias("cursor"))
            page = {"limit": limit, "after": after, **filters}
            if spec.snapshot:
                shown = self._rows(spec.ask(snapshot(store, spec.table, (self.network, contract)), contract, **page))
            else:
                at = cursors.where(F.col("network") == self.network).first()
                shown = self._scanned(store, spec, contract, at["cursor"] if at else 0, first, last, page)
            rows = self._rows(reads.vouched(shown, own, store.read("walks"), cursors, contract, spec.kind, first, last, scan=not spec.snapshot).orderBy(*keys))
        key = paging.resume_key(shown, endpoint, self.network, contract, limit, keys, spec.snapshot, from_ledger=first, to_ledger=last, **filters).first()["resume_key"]
        return Answer(rows, key or (None if spec.snapshot else resume))

    def _rows(self, page: DataFrame) -> DataFrame:
        """A page's rows, of which there are at most :data:`paging.MOST`, apart from the files they came from."""
        return self.spark.createDataFrame(page.collect(), page.schema)

    def _scanned(self, store: Store, spec: Endpoint, contract: str, cursor: int, first: int, last: int, page: dict) -> DataFrame:
        """A page in chain order, from as few buckets as fill it: a page near its start does not read all that follows."""
        end, low = (min(last, cursor) if last else cursor), first
        if page["after"]:
            low = max(first, _ledger_of(page["after"][0]))
        size = OPENED * landing.BUCKET
        while True:
            high = min(end, low // landing.BUCKET * landing.BUCKET + size - 1)
            rows = store.read(spec.table, low, high).where(F.col("network") == self.network)
            shown = self._rows(spec.ask(rows, contract, first=first, last=last, **page))
            if high >= end or shown.agg(F.max("has_more")).first()[0]:
                return shown
            size *= MORE


def _ledger_of(chain_id: str) -> int:
    """Ledger of a chain-order id, which has it in the high 32 bits of its first number."""
    try:
        return int(chain_id.split("-")[0]) >> 32
    except ValueError as e:
        raise ValueError("the resume key is not valid") from e
