"""Filters of the read queries, chain order and keyset pages."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import MOVEMENT_NAMES

DEFAULT_LIMIT, MOST = 100, 1000
VERSION = 1
#: Ledgers within which rows are numbered at once.
SPAN = 4096
#: Lengths of the starts of text keys that spans can be made of, and how many spans there may be: rows of counts.
PREFIXES, MOST_SPANS = (1, 2, 4, 8, 12, 16, 24, 32, 48, 64), 1_000_000
#: Columns whose order is that of the chain.
CHAIN_IDS = ("id", "transfer_id")
ORDERS = {
    "events": ["id"],
    "state": ["key_xdr", "durability"],
    "state_changes": ["id"],
    "transfers": ["id"],
    "trustlines": ["account_id"],
    "trustline_changes": ["id"],
    "movements": ["transfer_id", "role"],
}


def ledger_bounds(rows: DataFrame, first: int = 1, last: int = 0) -> DataFrame:
    """Rows of ledgers from ``first`` to ``last``; 0 leaves the end open."""
    if first < 1 or (last and last < first):
        raise ValueError("ledger bounds start at 1 and do not run backwards")
    rows = rows.where(F.col("ledger_sequence") >= first)
    return rows.where(F.col("ledger_sequence") <= last) if last else rows


def equals(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Exact matches on columns; None matches all."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def topic_filter(rows: DataFrame, *topics: str | None) -> DataFrame:
    return equals(rows, **{f"topic{i}": t for i, t in enumerate(topics)})


def account_filter(rows: DataFrame, account: str | None = None, sender: str | None = None, receiver: str | None = None) -> DataFrame:
    """``account`` matches either side and cannot be combined with one side."""
    if account is not None and (sender is not None or receiver is not None):
        raise ValueError("give either account, or from and to")
    if account is not None:
        return rows.where((F.col("from") == account) | (F.col("to") == account))
    return equals(rows, **{"from": sender, "to": receiver})


def transfer_type_filter(rows: DataFrame, kind: str | None) -> DataFrame:
    if kind is not None and kind not in MOVEMENT_NAMES:
        raise ValueError(f"not a transfer type: {kind}")
    return equals(rows, transfer_type=kind)


def role_filter(rows: DataFrame, role: str | None) -> DataFrame:
    if role not in (None, "sender", "recipient"):
        raise ValueError(f"not a role: {role}")
    return equals(rows, role=role)


def keyset_after(rows: DataFrame, keys: list[str], values: tuple | None) -> DataFrame:
    """Rows strictly after ``values`` in the order of ``keys``, in a form that reaches the Parquet scan."""
    if values is None:
        return rows

    def after(i: int) -> Column:
        same = [F.col(k) == v for k, v in zip(keys[:i], values)]
        return reduce(lambda a, b: a & b, same, F.col(keys[i]) > values[i])

    return rows.where(reduce(lambda a, b: a | b, [after(i) for i in range(len(keys))]))


def page(rows: DataFrame, keys: list[str], limit: int = DEFAULT_LIMIT, after: tuple | None = None) -> DataFrame:
    """The next ``limit`` rows in order, with ``has_more``: one row more is read to tell."""
    if not 1 <= limit <= MOST:
        raise ValueError(f"the limit is 1 to {MOST}")
    read = keyset_after(rows, keys, after).orderBy(*keys).limit(limit + 1)
    place = F.row_number().over(W.orderBy(*keys))
    # at most limit + 1 rows reach this window
    return read.withColumns({"_n": place, "has_more": F.count("*").over(W.partitionBy()) > limit}).where(F.col("_n") <= limit).drop("_n")


def spans(rows: DataFrame, group: list[str], keys: list[str]) -> Column:
    """A column in which rows of a group can be parted in the order of ``keys``: ledgers, or how a text key starts.

    The starts are as long as they can be without there being more than ``MOST_SPANS`` of them, which is counted
    (approximately: this decides how fast pages are numbered, never how). Other keys have a single span.
    """
    if keys[0] in CHAIN_IDS and "ledger_sequence" in rows.columns:
        return F.expr(f"ledger_sequence div {SPAN}")
    if rows.schema[keys[0]].dataType != T.StringType():
        return F.lit(0).cast("long")
    # a null key comes first, and so does an empty one: both are in the first span, and are told apart inside it
    start = lambda n: F.substring(F.coalesce(keys[0], F.lit("")), 1, n)
    seen = rows.agg(*[F.approx_count_distinct(F.xxhash64(*group, start(n))) for n in PREFIXES]).first()
    return start(max((n for n, count in zip(PREFIXES, seen) if count <= MOST_SPANS), default=1))


def paginate_all(rows: DataFrame, group: list[str], keys: list[str], limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Every page of every group: page number, rows, and the key it ends with.

    Rows are numbered within :func:`spans` of their group and the counts of earlier spans are added, so that no task
    holds a whole group, however large.
    """
    rows = rows.withColumn("_span", spans(rows, group, keys))
    before = W.partitionBy(*group).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy(*group, "_span").count().select(*group, "_span", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy(*group, "_span").orderBy(*keys))
    numbered = rows.withColumn("_n", place).join(starts, [*group, "_span"]).withColumn("page", F.ceil((F.col("_n") + F.col("_start")) / limit).cast("int"))
    return numbered.groupBy(*group, "page").agg(F.count("*").alias("n_rows"), F.max(F.struct(*keys)).alias("_last")).select(*group, "page", "n_rows", *[F.col(f"_last.{k}").alias(f"last_{k}") for k in keys])


def resume_key(shown: DataFrame, endpoint: str, network: str, contract: str, limit: int, keys: list[str], snapshot: bool, **filters: str | int) -> DataFrame:
    """The whole query and its last row as JSON text; snapshot pages have one only if more follows."""
    last = shown.agg(F.max(F.struct(*keys)).alias("last"), F.max("has_more").alias("has_more"))
    query = {"version": VERSION, "endpoint": endpoint, "network": network, "contract": contract, "limit": limit, **filters}
    key = F.struct(*[F.lit(v).alias(k) for k, v in query.items()], "last")
    wanted = F.col("last").isNotNull() & (F.col("has_more") if snapshot else F.lit(True))
    return last.select(F.when(wanted, F.to_json(key)).alias("resume_key"))


def read_resume_key(text: str, endpoint: str, network: str, contract: str, keys: list[str]) -> tuple[int, tuple, dict]:
    """Limit, place and filters of a resume key, for the query that goes on after it; it comes from outside and is not trusted."""
    try:
        found = json.loads(text)
        version, own = found.pop("version"), (found.pop("endpoint"), found.pop("network"), found.pop("contract"))
        limit, place = found.pop("limit"), found.pop("last")
        last = tuple(place[k] for k in keys)
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        raise ValueError("the resume key is not valid") from e
    if version != VERSION:
        raise ValueError(f"resume key of version {version!r}")
    if own != (endpoint, network, contract):
        raise ValueError("the resume key belongs to another endpoint, network or contract")
    if not isinstance(limit, int) or not 1 <= limit <= MOST:
        raise ValueError(f"the limit is 1 to {MOST}")
    return limit, last, found


def event_counts_by_name(events: DataFrame) -> DataFrame:
    return events.groupBy("network", "contract_id", F.coalesce("event_name", F.lit("")).alias("event_name")).agg(F.count("*").alias("n"))


def count_state_entries(snapshot: DataFrame) -> DataFrame:
    return snapshot.where(~F.col("deleted")).groupBy("network", "contract_id").agg(F.count("*").alias("n"))
