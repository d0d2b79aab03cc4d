import json

import pytest
from ledgerkit import N, content, land_all, register
from pyspark.sql import functions as F

from tideline.jobs.status import status
from tideline.plans import reads
from tideline.plans.served import Reader
from tideline.sources import landing
from tideline.sources.store import Store
from tideline.streaming.live import Live


def follow(reader, endpoint, contract, **more):
    """All pages, one after the other."""
    pages, key = [], None
    while True:
        answer = reader.ask(endpoint, contract, resume=key, **({} if key else more))
        rows = answer.rows.where(F.col("from_ledger").isNotNull()).collect()
        pages.append(rows)
        key = answer.resume_key
        if key is None or not rows[0]["has_more"]:
            return pages, key


def test_pages_of_a_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landing, "BUCKET", 4)
    root, store = f"{tmp_path}/landing", f"{tmp_path}/store"
    land_all(spark, root, range(1, 41))
    register(spark, root)
    reader = Reader(spark, root, store, N)
    before = reader.ask("events", "C1").rows.collect()
    assert [(r["id"], r["status"], r["to_ledger"], r["has_more"]) for r in before] == [(None, "WAITING_FOR_LEDGERS", 0, False)]
    live = Live(spark, root, store, N)
    live.start(f"{tmp_path}/checkpoint").awaitTermination()

    opened, read = [], Store.read

    def seen(self, table, first=None, last=None):
        if table == "events" and first is not None:
            opened.append((first, last))
        return read(self, table, first, last)

    monkeypatch.setattr(Store, "read", seen)
    pages, key = follow(reader, "events", "C1", limit=28)
    want = [r["id"] for r in live.stored("events").where("contract_id = 'C1'").orderBy("id").collect()]
    assert [r["id"] for rows in pages for r in rows] == want and len(pages) == 3
    # the first four buckets fill a page; the next one begins with the ledger where it ended
    assert opened[0] == (1, 15) and opened[1] == (14, 27) and all(first >= 14 for first, _ in opened[1:])
    assert [rows[-1]["status"] for rows in pages] == ["HAS_MORE", "HAS_MORE", "WAITING_FOR_LEDGERS"]
    # nothing new: the key stays good, and finds what lands later
    again = reader.ask("events", "C1", resume=key)
    assert again.resume_key == key and [r["id"] for r in again.rows.collect()] == [None]
    land_all(spark, root, range(41, 43))
    live.start(f"{tmp_path}/checkpoint").awaitTermination()
    assert [r["ledger_sequence"] for r in reader.ask("events", "C1", resume=key).rows.collect()] == [41, 41, 42, 42]

    some = reader.ask("transfers", "C1", first=10, last=20, account="G1").rows.collect()
    assert {r["ledger_sequence"] for r in some} == set(range(10, 21)) and {r["status"] for r in some} <= {"COMPLETE", "OLDEST_REACHED"}
    states, key = follow(reader, "state", "C1", limit=1)
    assert key is None and [str(r["key_xdr"]) for rows in states for r in rows] == sorted(r["key_xdr"] for r in live.state("C1").where("not deleted").collect())
    with pytest.raises(reads.UnknownContract):
        reader.ask("events", "C9")
    with pytest.raises(ValueError):
        reader.ask("events", "C1", account="G1")
    good = json.loads(reader.ask("events", "C1", limit=1).resume_key)
    for wrong in ({"from_ledger": "x"}, {"last": {"id": "x"}}, {"topic9": "a"}, {"topic0": 1}, {"last": {"id": 5}}):
        with pytest.raises(ValueError):
            reader.ask("events", "C1", resume=json.dumps(good | wrong))


def test_readers_leave_the_work_of_a_running_job_alone(spark, tmp_path):
    root, store = f"{tmp_path}/landing", f"{tmp_path}/store"
    land_all(spark, root, range(1, 4))
    register(spark, root)
    live = Live(spark, root, store, N)
    with live.tables.pinned() as tables:
        work = tables.staged(spark.range(5), "rows")
        status(spark, root, store, N).collect()
        Reader(spark, root, store, N).ask("events", "C1").rows.collect()
        assert work.count() == 5
    assert content(live)["events"] == []
