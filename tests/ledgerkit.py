"""Small landing folders for tests of the jobs: ledgers with one transaction each, two events and two entry changes."""

from pyspark.sql import functions as F

from tideline import schemas
from tideline.sources import landing

N = "testnet"


def ledger_rows(span, bad=(), prefix="h"):
    return [(N, k, f"{prefix}{k}", "bad" if k in bad else f"{prefix}{k - 1}", None) for k in span]


def transaction_rows(span, failed=()):
    return [(N, k, None, 1, f"t{k}", k not in failed, True) for k in span]


def event_rows(span, contract="C1", positions=(0, 1), text="e"):
    """Transfers from C1's account to C2, the second one undecodable every third ledger."""
    rows = []
    for k in span:
        for p in positions:
            topics = [("symbol", "transfer", "b0"), ("address", "G1", "b1"), ("address", "C2", "b2")]
            value = ("i128", f"{'-' if p and k % 3 == 0 else ''}{k}", None, "b")
            rows.append((N, k, None, 1, f"t{k}", 0, p, "contract", contract, 0, topics, value, f"{text}{k}.{p}"))
    return rows


def change_rows(span):
    side = lambda k: ("C1", f"K{k % 4}", f"v{k}", "persistent", None, None, None, None, None, None)
    line = lambda k: (None, None, None, None, f"G{k % 3}", "A1", "credit", k, 100, 0)
    return [(N, k, None, 1, f"t{k}", 0, p, t, "removed" if k % 7 == 0 else "created", s if k % 7 == 0 else None, None if k % 7 == 0 else s) for k in span for p, (t, s) in enumerate((("contract_data", side(k)), ("trustline", line(k))))]


ROWS = {"ledgers": ledger_rows, "transactions": transaction_rows, "raw_events": event_rows, "raw_changes": change_rows}


def land(spark, root, name, rows, pieces=1):
    landing.land(spark.createDataFrame(rows, schemas.LANDING[name]).coalesce(pieces), f"{root}/{name}")


def land_all(spark, root, span, **more):
    for name, make in ROWS.items():
        land(spark, root, name, make(span, **more.get(name, {})))


def register(spark, root, kinds=("events", "transfers", "state")):
    rows = [(N, "C1", "admin", list(kinds), None), (N, "S1", "admin", ["trustlines"], None), (N, "C2", "admin", ["movements"], None)]
    spark.createDataFrame(rows, schemas.REGISTRATIONS).write.mode("overwrite").parquet(f"{root}/registrations")
    spark.createDataFrame([(N, "A1", "S1")], schemas.ASSETS).write.mode("overwrite").parquet(f"{root}/assets")


def content(live):
    """All that the store has of the five data sets and both snapshots, as sorted text."""
    out = {t: sorted(map(str, live.stored(t).collect())) for t in ("events", "transfers", "movements", "state_changes", "trustline_changes")}
    return out | {"state": sorted(map(str, live.state().collect())), "trustlines": sorted(map(str, live.trustlines().collect()))}


def walks_frame(spark, rows):
    return spark.createDataFrame(rows, schemas.BACKFILL)


def requests(spark, rows):
    return spark.createDataFrame(rows, "network string, contract_id string, target_from bigint, anchor bigint, kinds array<string>")


def gap(spark, first, last):
    row = (f"gap:{N}:{first}:{last}", N, first, last, "test", None, None, None)
    return spark.createDataFrame([row], schemas.GAPS).withColumn("recorded_at", F.current_timestamp())
