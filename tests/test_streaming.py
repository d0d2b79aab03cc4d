import random

import pytest
from ledgerkit import N, change_rows, content, event_rows, land, land_all, ledger_rows, register, transaction_rows
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tideline import schemas
from tideline.operators import integrity
from tideline.plans import views
from tideline.sources import landing
from tideline.streaming.live import ChainDiverged, Live, streaming_snapshot

DATA = "/root/testdata/sf0.001"


def land_tables(spark, root, tamper=False):
    raw = views.raw_events(spark, DATA)
    ledgers = views.ledgers(spark, DATA)
    if not tamper:
        ledgers = ledgers.withColumn("previous_hash", F.md5((F.col("ledger_sequence") - 1).cast("string")))
    landing.land(ledgers.select("network", "ledger_sequence", "hash", "previous_hash", "closed_at"), f"{root}/ledgers")
    landing.land(views.transactions(spark, DATA), f"{root}/transactions")
    views.registrations(spark, DATA).drop("user_id").write.mode("overwrite").parquet(f"{root}/registrations")
    landing.land(raw.repartition(3, "ledger_sequence"), f"{root}/raw_events")


def test_live_equals_batch_and_replays(spark, tmp_path):
    from tideline.queries import F3_watched, _transfers

    root = str(tmp_path)
    land_tables(spark, f"{root}/landing")
    live = Live(spark, f"{root}/landing", f"{root}/store", "testnet")
    live.start(f"{root}/checkpoint").awaitTermination()
    want = sorted(r["id"] for r in F3_watched(spark, DATA).collect())
    assert sorted(r["id"] for r in live.stored("events").collect()) == want
    assert live.stored("transfers").count() == _transfers(spark, DATA).count()
    top = views.ledgers(spark, DATA).agg(F.max("ledger_sequence")).first()[0]
    assert live.cursor().first()["ledger_sequence"] == top
    land_tables(spark, f"{root}/landing")  # the same rows land again
    live.start(f"{root}/checkpoint").awaitTermination()
    assert sorted(r["id"] for r in live.stored("events").collect()) == want
    # nothing was derived anew
    assert live.tables._raw("events", schemas.EVENTS, live.tables.log()).count() == len(want)


def test_divergence_halts_before_writing(spark, tmp_path):
    root = f"{tmp_path}/landing"
    land_all(spark, root, range(1, 5), ledgers={"bad": (3,)})
    register(spark, root)
    live = Live(spark, root, f"{tmp_path}/store", N)
    with pytest.raises(StreamingQueryException):
        live.start(f"{tmp_path}/checkpoint").awaitTermination()
    assert live.stored("events").isEmpty() and live.cursor().isEmpty()


def test_two_hashes_of_one_ledger_halt(spark, tmp_path):
    root = f"{tmp_path}/landing"
    land_all(spark, root, range(1, 5))
    register(spark, root)
    live = Live(spark, root, f"{tmp_path}/store", N)
    live.process(spark.createDataFrame(ledger_rows(range(1, 5)), schemas.LEDGERS), 0)
    land(spark, root, "ledgers", [(N, 4, "other", "h3", None)])
    with pytest.raises(ChainDiverged):
        live.process(spark.createDataFrame(ledger_rows([4]), schemas.LEDGERS), 1)


def test_streaming_snapshot(spark, tmp_path):
    from tideline.operators.snapshots import state_snapshot

    rows = views.state_rows(spark, DATA).dropDuplicates(["id"])
    rows.repartition(4).write.parquet(f"{tmp_path}/changes")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/changes")
    columns = ["contract_id", "key_xdr", "durability", "last_ledger", "value", "deleted"]
    want = sorted(map(str, state_snapshot(rows).select(*columns).collect()))
    query = streaming_snapshot(stream).writeStream.outputMode("complete").format("memory").queryName("snapshot").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, spark.table("snapshot").select(*columns).collect())) == want
    # in update mode each batch has the keys that it changes; the last row of each is the entry
    seen = {}
    keep = lambda batch, _: seen.update({tuple(r[c] for c in columns[:3]): str(r) for r in batch.select(*columns).collect()})
    query = streaming_snapshot(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(seen.values()) == want


def dirty(spark, *numbers):
    return spark.createDataFrame([(N, k) for k in numbers], "network string, ledger_sequence long")


def test_live_commits_changes_snapshots_hashes_and_counters(spark, tmp_path):
    root = f"{tmp_path}/landing"
    land_all(spark, root, range(1, 11), transactions={"failed": (4,)})
    register(spark, root)
    live = Live(spark, root, f"{tmp_path}/store", N, start_at=2)
    for numbers, batch in ((range(1, 4), 0), (range(4, 11), 1), (range(4, 11), 1)):  # the last is a replay
        live.process(dirty(spark, *numbers), batch)
    want = [2, 3, 5, 6, 7, 8, 9, 10]
    for table in ("state_changes", "trustline_changes"):
        assert sorted(r["ledger_sequence"] for r in live.stored(table).collect()) == want
    assert {r["key_xdr"]: (r["value"], r["last_ledger"], r["deleted"]) for r in live.state().collect()} == {"K0": ("v8", 8, False), "K1": ("v9", 9, False), "K2": ("v10", 10, False), "K3": (None, 7, True)}
    assert {r["account_id"]: (r["contract_id"], r["balance"]) for r in live.trustlines().collect()} == {"G0": ("S1", 9), "G1": ("S1", 10), "G2": ("S1", 8)}
    assert [r["key_xdr"] for r in live.state("C2").collect()] == [] and live.state("C1").count() == 4
    assert sorted((r["ledger_sequence"], r["hash"]) for r in live.hashes().collect()) == [(k, f"h{k}") for k in range(2, 11)]
    assert sorted(r["amount"] for r in live.stored("transfers").where("event_index = 1").collect()) == sorted(str(k) for k in want if k % 3)
    assert {r["contract_id"] for r in live.stored("movements").collect()} == {"C2"}
    assert live.tables.counters() == {"failed_txs": 1, "suppressed_txs": 0, "suppressed_events": 0, "suppressed_transfers": 3, "suppressed_trustlines": 0, "foreign_undecodable": 0}
    assert len(live.tables.log()) == 2


@pytest.mark.parametrize("bad", [3, 6, 9])
def test_quiet_ledgers_are_chained_to_the_cursor(spark, tmp_path, bad):
    root = f"{tmp_path}/landing"
    land(spark, root, "ledgers", ledger_rows(range(1, 11), (bad,)))
    register(spark, root)
    live = Live(spark, root, f"{tmp_path}/store", N)
    live.process(dirty(spark, 1), 0)
    with pytest.raises(ChainDiverged):
        live.process(dirty(spark, *range(2, 11)), 1)
    assert live.cursor().first()["ledger_sequence"] == 1


def test_ledgers_without_events_advance_the_cursor(spark, tmp_path):
    root = f"{tmp_path}/landing"
    land(spark, root, "ledgers", ledger_rows(range(1, 6)))
    register(spark, root)
    live = Live(spark, root, f"{tmp_path}/store", N)
    live.start(f"{tmp_path}/checkpoint").awaitTermination()
    assert live.cursor().first()["ledger_sequence"] == 5 and live.gaps().isEmpty()


@pytest.mark.parametrize("seed", [1])
def test_any_order_of_landing_gives_the_batch_result(spark, tmp_path, seed):
    span = range(1, 9)
    root = f"{tmp_path}/landing"
    land_all(spark, root, span)
    register(spark, root)
    live = Live(spark, root, f"{tmp_path}/store", N)
    live.start(f"{tmp_path}/checkpoint").awaitTermination()
    want = content(live)
    # rows of one ledger and table land as files of their own, events one by one, in any order, some of them twice
    pieces = [(name, make([k])) for k in span for name, make in (("ledgers", ledger_rows), ("transactions", transaction_rows), ("raw_changes", change_rows))]
    pieces += [("raw_events", event_rows([k], positions=(p,))) for k in span for p in (0, 1)]
    rng = random.Random(seed)
    rng.shuffle(pieces)
    pieces += rng.sample(pieces, 3)
    root = f"{tmp_path}/shuffled"
    register(spark, root)
    other = Live(spark, root, f"{tmp_path}/store2", N)
    for at in range(0, len(pieces), 9):
        for name, rows in pieces[at : at + 9]:
            land(spark, root, name, rows)
        other.start(f"{tmp_path}/checkpoint2").awaitTermination()
        if at % 18 == 9:
            other.compact(fanout=2)
    assert content(other) == want and len(want["events"]) == 16
    assert integrity.list_open_gaps(other.gaps()).isEmpty() and other.cursor().first()["ledger_sequence"] == 8


def test_late_rows_replace_their_ledger_and_keep_rows_of_others(spark, tmp_path):
    root = f"{tmp_path}/landing"
    for name, rows in (("ledgers", ledger_rows(range(1, 5))), ("transactions", transaction_rows(range(1, 5))), ("raw_events", event_rows(range(1, 5), positions=(1,))), ("raw_events", event_rows([2], "C9", positions=(2,)))):
        land(spark, root, name, rows)
    spark.createDataFrame([(N, c, "admin", ["events"], None) for c in ("C1", "C9")], schemas.REGISTRATIONS).write.parquet(f"{root}/registrations")
    live = Live(spark, root, f"{tmp_path}/store", N)
    live.process(dirty(spark, *range(1, 5)), 0)
    seen = lambda: sorted((r["ledger_sequence"], r["contract_id"], r["event_index"], r["raw_b64"]) for r in live.stored("events").where("ledger_sequence = 2").collect())
    assert seen() == [(2, "C1", 0, "e2.1"), (2, "C9", 1, "e2.2")]
    reader = live.stored("events")  # a reader that began before
    # C9 is unregistered, and an earlier event of ledger 2 lands: the stored row of C9 stays, C1's are numbered anew
    register(spark, root)
    land(spark, root, "raw_events", event_rows([2], positions=(0,)))
    live.process(dirty(spark, 2), 1)
    assert seen() == [(2, "C1", 0, "e2.0"), (2, "C1", 1, "e2.1"), (2, "C9", 1, "e2.2")]
    assert reader.where("ledger_sequence = 2").count() == 2
    before = content(live)
    live.process(dirty(spark, 1, 2, 3), 2)  # nothing new has landed
    assert content(live) == before
    for _ in range(2):
        live.compact(fanout=2)
        assert content(live) == before
    assert live.tables.vacuum(seconds=0) and content(live) == before


def test_a_committed_batch_is_left_alone(spark, tmp_path):
    root = str(tmp_path)
    land_tables(spark, f"{root}/landing")
    live = Live(spark, f"{root}/landing", f"{root}/store", "testnet")
    batch = views.raw_events(spark, DATA)
    counts = []
    for _ in range(2):
        live.process(batch, 0)
        counts.append([live.stored(t).count() for t in ("events", "transfers", "movements", "hashes")])
    assert counts[0] == counts[1] and counts[0][0] > 0
    assert live.tables.markers().count() == 1


def test_a_new_checkpoint_overwrites_nothing(spark, tmp_path):
    root = f"{tmp_path}/landing"
    land_all(spark, root, range(1, 9))
    register(spark, root)
    live = Live(spark, root, f"{tmp_path}/store", N)
    live.start(f"{tmp_path}/checkpoint-1", max_files=1).awaitTermination()
    want = content(live)
    live.start(f"{tmp_path}/checkpoint-2").awaitTermination()
    assert content(live) == want
    streams = {r["stream"] for r in live.tables.markers().collect()}
    assert len(streams) == 2 and "direct" not in streams


def test_a_transaction_in_two_files_is_numbered_as_one(spark, tmp_path):
    root = f"{tmp_path}/landing"
    land_all(spark, root, range(1, 4), raw_events={"positions": ()})
    register(spark, root)
    for pos in (1, 0):
        land(spark, root, "raw_events", event_rows([2], positions=(pos,)))
    live = Live(spark, root, f"{tmp_path}/store", N)
    live.start(f"{tmp_path}/checkpoint", max_files=1).awaitTermination()
    assert sorted((r["raw_b64"], r["event_index"]) for r in live.stored("events").collect()) == [("e2.0", 0), ("e2.1", 1)]


@pytest.mark.parametrize("hole", [3, 6])
def test_a_hole_is_a_gap_until_it_lands(spark, tmp_path, hole):
    root = f"{tmp_path}/landing"
    span = [k for k in range(1, 10) if k != hole]
    land_all(spark, root, span)
    register(spark, root)
    live = Live(spark, root, f"{tmp_path}/store", N)
    live.process(dirty(spark, 1, 2), 0)
    strict = Live(spark, root, live.store, N, strict=True)
    with pytest.raises(ChainDiverged):
        strict.process(dirty(spark, *range(3, 10)), 1)
    assert live.cursor().first()["ledger_sequence"] == 2
    live.process(dirty(spark, *range(3, 10)), 1)
    assert [r["id"] for r in integrity.list_open_gaps(live.gaps()).collect()] == [f"gap:testnet:{hole}:{hole}"]
    assert hole not in {r["ledger_sequence"] for r in live.stored("state_changes").collect()}
    land_all(spark, root, [hole])
    live.process(dirty(spark, hole), 2)
    assert integrity.list_open_gaps(live.gaps()).isEmpty()
    (row,) = live.gaps().collect()
    assert row["resolved_at"] is not None and row["heal_next_to"] == hole - 1
    assert hole in {r["ledger_sequence"] for r in live.stored("state_changes").collect()} and live.cursor().first()["ledger_sequence"] == 9


def test_a_gap_is_healed_from_its_end_and_clamped_walks_follow(spark, tmp_path):
    from ledgerkit import walks_frame

    root = f"{tmp_path}/landing"
    land_all(spark, root, [1, 2, 9, 10])
    register(spark, root)
    live = Live(spark, root, f"{tmp_path}/store", N)
    live.process(dirty(spark, 1, 2, 9, 10), 0)
    live.tables.commit({"walks": walks_frame(spark, [(N, "C1", 3, 8, True, 9, ["events"]), (N, "S1", 6, 8, True, 9, ["trustlines"]), (N, "C2", 1, 4, True, 5, ["movements"])])})
    gaps = lambda: [(r["from_sequence"], r["to_sequence"], r["heal_next_to"]) for r in integrity.list_open_gaps(live.gaps()).collect()]
    walks = lambda: {r["contract_id"]: (r["next_to"], r["clamped_at"]) for r in live.walks().collect()}
    assert gaps() == [(3, 8, 8)]
    for batch, (lands, left, after) in enumerate((
        ([5], [(3, 8, 8)], {"C1": (8, 9), "S1": (8, 9), "C2": (4, 5)}),
        ([7, 8], [(3, 8, 6)], {"C1": (6, 9), "S1": (6, 9), "C2": (4, 5)}),
        ([6], [(3, 8, 4)], {"C1": (4, 9), "S1": (5, None), "C2": (4, 5)}),
        ([3, 4], [], {"C1": (2, None), "S1": (5, None), "C2": (4, 5)}),
    )):
        land_all(spark, root, lands)
        live.process(dirty(spark, *lands), batch + 1)
        assert gaps() == left and walks() == after
    assert sorted({r["ledger_sequence"] for r in live.stored("events").collect()}) == list(range(1, 11))


def test_a_crash_before_the_marker_leaves_nothing(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/landing"
    land_all(spark, root, range(1, 4))
    register(spark, root)
    live = Live(spark, root, f"{tmp_path}/store", N)
    write = live.tables._write

    def crash(table, rows, attempt):
        if table == "cursors":
            raise RuntimeError("lost")
        return write(table, rows, attempt)

    monkeypatch.setattr(live.tables, "_write", crash)
    with pytest.raises(RuntimeError):
        live.process(dirty(spark, 1, 2, 3), 0)
    monkeypatch.undo()
    assert live.stored("events").isEmpty() and live.cursor().isEmpty()
    live.process(dirty(spark, 1, 2, 3), 0)
    assert live.stored("events").count() == 6
    left = live.tables.vacuum(seconds=0)
    assert left and live.stored("events").count() == 6


def test_merges_keep_each_networks_cursor(spark, tmp_path):
    root = f"{tmp_path}/landing"
    land(spark, root, "ledgers", [(n, k, f"{n}{k}", f"{n}{k - 1}", None) for n in ("a", "b") for k in range(1, 12)])
    spark.createDataFrame([], schemas.REGISTRATIONS).write.parquet(f"{root}/registrations")
    both = {n: Live(spark, root, f"{tmp_path}/store", n) for n in ("a", "b")}
    for batch, upto in enumerate((3, 6, 9)):
        for n, live in both.items():
            live.process(spark.createDataFrame([(n, k) for k in range(1, upto + (n == "a"))], "network string, ledger_sequence long"), batch, f"s-{n}")
    cursors = lambda: sorted((r["network"], r["ledger_sequence"]) for r in both["a"].cursor().collect())
    assert cursors() == [("a", 9), ("b", 8)]
    assert both["a"].compact(fanout=3) and cursors() == [("a", 9), ("b", 8)] and len(both["a"].tables.log()) < 6
    assert [r["ledger_sequence"] for r in both["a"].stored("hashes").where("network = 'b'").orderBy("ledger_sequence").collect()] == list(range(1, 9))
    both["b"].process(spark.createDataFrame([("b", 1)], "network string, ledger_sequence long"), 0, "s-b")  # still known
    assert both["b"].tables.markers().where("stream = 's-b'").count() == 3
