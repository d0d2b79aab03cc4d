import random
from datetime import datetime, timedelta

import pytest
from ledgerkit import N, content, gap, land, land_all, ledger_rows, register, requests, walks_frame
from pyspark.sql import functions as F

from tideline import schemas
from tideline.jobs.heal import FAILED, UNVERIFIED, VERIFIED, Healer
from tideline.jobs.rates import Rates
from tideline.jobs.rederive import rederive
from tideline.jobs.status import status
from tideline.jobs.walk import Walker
from tideline.operators import coverage, history, integrity, ops, paging
from tideline.plans import reads
from tideline.sources import landing
from tideline.sources.store import Store
from tideline.streaming.live import Live


def walk_rows(frame):
    return {r["contract_id"]: (r["next_to"], r["done"], r["clamped_at"]) for r in frame.collect()}


def seqs(frame, **where):
    rows = frame
    for k, v in where.items():
        rows = rows.where(F.col(k) == v)
    return sorted({r["ledger_sequence"] for r in rows.collect()})


def test_walks_derive_what_live_would(spark, tmp_path):
    root = f"{tmp_path}/landing"
    land_all(spark, root, range(1, 31))
    register(spark, root)
    live = Live(spark, root, f"{tmp_path}/live", N)
    live.start(f"{tmp_path}/checkpoint").awaitTermination()
    walker = Walker(spark, root, f"{tmp_path}/walked", N, size=7)
    walker.request(requests(spark, [(N, "C1", 1, 30, ["events", "transfers", "state"]), (N, "S1", 1, 30, ["trustlines"]), (N, "C2", 11, 30, ["movements"])]))
    assert walker.run(chunks=2) >= 3
    assert walk_rows(walker.walks()) == {"C1": (0, True, None), "S1": (0, True, None), "C2": (10, True, None)}
    other = Live(spark, root, f"{tmp_path}/walked", N)
    want = content(live)
    want["movements"] = [r for r in want["movements"] if int(r.split("ledger_sequence=")[1].split(",")[0]) > 10]
    assert content(other) == want and want["movements"]
    assert walker.run() == 0
    # the live job goes on in the same store, over ledgers that were walked: nothing is stored twice
    other.start(f"{tmp_path}/checkpoint2").awaitTermination()
    assert content(other) == content(live)


def test_a_walk_stops_above_a_hole_and_goes_on_when_it_lands(spark, tmp_path):
    root = f"{tmp_path}/landing"
    land_all(spark, root, [k for k in range(1, 31) if k != 12])
    register(spark, root)
    walker = Walker(spark, root, f"{tmp_path}/store", N, size=5)
    walker.request(requests(spark, [(N, "C1", 1, 30, ["events"]), (N, "C2", 21, 30, ["movements"])]))
    walker.run()
    # the chunk 11 to 15 has the hole
    assert walk_rows(walker.walks()) == {"C1": (15, False, None), "C2": (20, True, None)}
    assert seqs(walker.tables.read("events")) == list(range(16, 31)) and walker.tables.read("gaps").isEmpty()
    land_all(spark, root, [12])
    walker.run()
    assert walk_rows(walker.walks())["C1"] == (0, True, None) and seqs(walker.tables.read("events")) == list(range(1, 31))


def test_a_walk_waits_for_its_anchor_and_for_a_broken_chain(spark, tmp_path):
    root = f"{tmp_path}/landing"
    land_all(spark, root, range(1, 11), ledgers={"bad": (4,)})
    register(spark, root)
    walker = Walker(spark, root, f"{tmp_path}/store", N, size=5)
    walker.request(requests(spark, [(N, "C1", 1, 14, ["events"]), (N, "C2", 1, 10, ["movements"])]))
    walker.run()
    assert walk_rows(walker.walks()) == {"C1": (14, False, None), "C2": (5, False, None)}


def test_walls_clamp_with_one_gap_in_the_same_commit(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/landing"
    land_all(spark, root, range(12, 31))
    register(spark, root)
    walker = Walker(spark, root, f"{tmp_path}/store", N, size=5)
    walker.request(requests(spark, [(N, "C1", 1, 30, ["events"]), (N, "S1", 3, 9, ["trustlines"]), (N, "C2", 14, 30, ["movements"])]))
    before = len(walker.tables.log())
    mark = Store.commit

    def crash(self, tables, *args, **kwargs):
        raise RuntimeError("lost")

    monkeypatch.setattr(Store, "commit", crash)
    with pytest.raises(RuntimeError):
        walker.step()
    monkeypatch.setattr(Store, "commit", mark)
    assert walk_rows(walker.walks())["C1"] == (30, False, None) and walker.tables.read("gaps").isEmpty()
    walker.step()
    assert len(walker.tables.log()) == before + 1
    assert walk_rows(walker.walks()) == {"C1": (11, True, 12), "S1": (9, True, 10), "C2": (13, True, None)}
    assert sorted((r["from_sequence"], r["to_sequence"]) for r in integrity.list_open_gaps(walker.tables.read("gaps")).collect()) == [(1, 11), (3, 9)]
    assert seqs(walker.tables.read("events")) == list(range(12, 31)) and seqs(walker.tables.read("movements"))[0] == 14


def test_an_unregistered_walk_does_not_move(spark, tmp_path):
    root = f"{tmp_path}/landing"
    land_all(spark, root, range(1, 6))
    register(spark, root)
    walker = Walker(spark, root, f"{tmp_path}/store", N)
    walker.request(requests(spark, [(N, "C9", 1, 5, ["events"])]))
    assert walker.run() == 0 and walk_rows(walker.walks()) == {"C9": (5, False, None)}


# healing


def healing(spark, tmp_path, holes, cursor=400, size=7, corrupt=None):
    """A store whose landing folder lacks ``holes``, with gaps for them, and an archive that has all."""
    primary, archive = f"{tmp_path}/landing", f"{tmp_path}/archive"
    missing = {k for lo, hi in holes for k in range(lo, hi + 1)}
    low = min(missing) - 2
    span = sorted({k for lo, hi in ((low, max(missing) + 3), (cursor - 90, cursor)) for k in range(lo, hi + 1)} - missing)
    land_all(spark, primary, span)
    register(spark, primary)
    land_all(spark, archive, sorted({*range(low, max(missing) + 4), *range(cursor - 90, cursor + 1)}), raw_events={"text": corrupt or "e"})
    live = Live(spark, primary, f"{tmp_path}/store", N)
    live.process(spark.createDataFrame([(N, k) for k in span], "network string, ledger_sequence long"), 0)
    return live, Healer(spark, archive, primary, f"{tmp_path}/store", N, size=size)


def test_a_gap_is_healed_in_chunks_behind_the_gate(spark, tmp_path):
    live, healer = healing(spark, tmp_path, [(10, 27)])
    live.tables.commit({"walks": walks_frame(spark, [(N, "C1", 12, 27, True, 28, ["events"])])})
    open_gaps = lambda: [(r["from_sequence"], r["heal_next_to"]) for r in integrity.list_open_gaps(live.gaps()).collect()]
    assert (10, 27) in open_gaps() and healer.state == UNVERIFIED
    seen = []
    while (10, 27) in open_gaps() or any(lo == 10 for lo, _ in open_gaps()):
        assert healer.step()
        seen.append(next((to for lo, to in open_gaps() if lo == 10), None))
        if len(seen) == 1:
            assert walk_rows(live.walks()) == {"C1": (20, True, 28)}
    assert seen == [20, 13, None] and healer.state == VERIFIED
    assert walk_rows(live.walks()) == {"C1": (11, True, None)}
    assert set(range(10, 28)) <= set(seqs(live.stored("events"))) and set(range(10, 28)) <= set(seqs(live.stored("trustline_changes")))
    # what was healed lands late after all: it is known
    land_all(spark, live.landing, range(10, 28))
    before = content(live)
    live.process(spark.createDataFrame([(N, k) for k in range(10, 28)], "network string, ledger_sequence long"), 1)
    assert content(live) == before


def test_a_feed_that_differs_disables_healing(spark, tmp_path):
    live, healer = healing(spark, tmp_path, [(10, 12)], corrupt="x")
    before = len(live.tables.log())
    assert not healer.step() and healer.state == FAILED and not healer.step()
    assert len(live.tables.log()) == before and not integrity.list_open_gaps(live.gaps()).isEmpty()


def test_the_gate_needs_ledgers_of_both_feeds(spark, tmp_path):
    live, healer = healing(spark, tmp_path, [(10, 12)], cursor=150)  # too low for a sample
    assert not healer.step() and healer.state == FAILED
    live, healer = healing(spark, f"{tmp_path}/b", [(10, 12), (319, 319)], cursor=400)
    assert list(integrity.equivalence_sample(400)) == list(range(312, 320))  # 319 never landed
    assert not healer.step() and healer.state == FAILED


def test_a_chunk_that_is_not_whole_waits(spark, tmp_path):
    live, healer = healing(spark, tmp_path, [(10, 12), (20, 22)], size=2)
    kept = spark.read.schema(f"{schemas.LEDGERS}, bucket bigint").parquet(f"{tmp_path}/archive/ledgers").where("ledger_sequence <> 11").drop("bucket").collect()
    spark.createDataFrame(kept, schemas.LEDGERS).withColumn("bucket", landing.bucket_of()).write.mode("overwrite").partitionBy("bucket").parquet(f"{tmp_path}/archive/ledgers")
    healer.run()
    left = {(r["from_sequence"], r["heal_next_to"]) for r in integrity.list_open_gaps(live.gaps()).collect()}
    assert (10, 12) in left and not any(lo == 20 for lo, _ in left) and healer.state == VERIFIED
    assert 21 in seqs(live.stored("events")) and 12 not in seqs(live.stored("events"))


# the store


def test_tiers_copy_a_row_a_class_and_readers_keep_what_they_have(spark, tmp_path):
    schema = "network string, contract_id string, tx_hash string, event_index int, id string, ledger_sequence bigint"
    store = Store(spark, str(tmp_path), {"events": schema}, {"marks": ("id string, v bigint", ["id"])})
    rng, want, first = random.Random(1), [], None
    for k in range(20):
        n = rng.choice([1, 2, 30])
        rows = [(N, "C", f"t{k}", i, f"{k:03d}-{i}", 40_000 * (k % 3) + k) for i in range(n)]
        want += [r[4] for r in rows]
        store.commit({"events": spark.createDataFrame(rows, schema), "marks": spark.createDataFrame([("a", k), (f"b{k}", k)], "id string, v bigint")}, counters=lambda k=k: {"n": k})
        store.compact(fanout=3)
        if k == 9:
            first = store.read("events"), list(want)
    ids = lambda rows: sorted(r["id"] for r in rows.collect())
    assert ids(store.read("events")) == sorted(want) and ids(first[0]) == sorted(first[1])
    assert {r["id"]: r["v"] for r in store.read("marks").collect()} == {"a": 19, **{f"b{k}": k for k in range(20)}}
    assert len(store.log()) <= 8 and store.counters() == {"n": sum(range(20))}
    gone = store.vacuum(seconds=0)
    assert gone and ids(store.read("events")) == sorted(want)
    # a day's range is read from its folders
    part = store.read("events", 40_000, 40_100)
    assert {r["ledger_sequence"] // 40_000 for r in part.collect()} == {1} and all("bucket=2/" in f for f in store.rows("events").where("bucket = 2").inputFiles() if "bucket=2/" in f)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_a_range_of_one_table_is_replaced(spark, tmp_path):
    """Rederiving with another decoder changes exactly its range, its table, and what readers open from then on."""
    schema = "network string, id string, ledger_sequence bigint, amount string"
    store = Store(spark, str(tmp_path), {"transfers": schema, "events": schema}, {})
    rows = lambda span, text: spark.createDataFrame([(N, f"{k:05d}", k, text) for k in span], schema)
    store.commit({"transfers": rows(range(0, 50_000, 1000), "old"), "events": rows(range(0, 50_000, 1000), "old")})
    before = store.read("transfers")
    mark = spark.createDataFrame([("transfers", N, 10_000, 30_000)], "table string, network string, first bigint, last bigint")
    store.commit({"transfers": rows(range(10_000, 30_001, 1000), "new")}, replaced=mark)
    got = {r["ledger_sequence"]: r["amount"] for r in store.read("transfers").collect()}
    assert got == {k: "new" if 10_000 <= k <= 30_000 else "old" for k in range(0, 50_000, 1000)} and store.read("transfers").count() == 50
    assert {r["amount"] for r in store.read("events").collect()} == {"old"} and {r["amount"] for r in before.collect()} == {"old"}
    for _ in range(3):
        store.commit({"transfers": rows([60_000], "x")})
        store.compact(fanout=2)
        assert store.read("transfers").where("ledger_sequence <= 50000").count() == 50


def test_a_decoder_that_changed_is_run_over_a_range(spark, tmp_path):
    root = f"{tmp_path}/landing"
    land_all(spark, root, range(1, 10))
    register(spark, root)
    live = Live(spark, root, f"{tmp_path}/store", N)
    live.process(spark.createDataFrame([(N, k) for k in range(1, 10)], "network string, ledger_sequence long"), 0)
    before = content(live)
    rederive(live.tables, live.feed, "transfers", 3, 6)
    assert content(live) == before

    def doubled(*args):
        made, audit = live.feed.derive(*args)
        return made | {"transfers": made["transfers"].withColumn("amount", F.concat("amount", F.lit("0")))}, audit

    # C1 is not registered for transfers any more: its rows stay as they were
    rederive(live.tables, live.feed, "transfers", 3, 6, doubled)
    got = {(r["ledger_sequence"], r["event_index"]): r["amount"] for r in live.stored("transfers").collect()}
    assert got == {(k, p): f"{k}0" if 3 <= k <= 6 else f"{k}" for k in range(1, 10) for p in (0, 1) if not (p and k % 3 == 0)}
    after = content(live)
    assert {t: rows for t, rows in after.items() if t != "transfers"} == {t: rows for t, rows in before.items() if t != "transfers"}
    register(spark, root, kinds=("events",))
    rederive(live.tables, live.feed, "transfers", 1, 9)
    assert content(live)["transfers"] == after["transfers"]


def test_rates_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows, value = [], {}
    for at in range(0, 3000, 40):
        for series in (("m", "a"), ("m", None), ("n", "a")):
            value[series] = 0 if rng.random() < 0.1 else value.get(series, 0) + rng.randrange(9)
            rows.append((*series, at, value[series]))
    frame = lambda some: spark.createDataFrame(some, "metric string, labels string, at long, value long").select("metric", "labels", F.timestamp_seconds("at").alias("ts"), "value")
    text = lambda found: sorted(map(str, found.collect()))
    want = text(ops.increase(frame(rows), "300 seconds"))
    rates = Rates(spark, f"{tmp_path}/store")
    cuts = [0, 40, 41, 120, len(rows)]
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        some = rows[lo:hi] + rows[lo : min(lo + 3, hi)]
        rng.shuffle(some)
        frame(some).coalesce(1).write.parquet(f"{tmp_path}/samples/{k}")
        rates.process(frame(some), k, "s")
        rates.process(frame(some), k, "s")  # the batch runs again
    assert text(rates.increase()) == want and rates.late_samples() == 0
    # a sample that is not after the last of its series adds nothing
    rates.process(frame([("m", "a", 1000, 10**6), ("m", "a", rows[-3][2], 10**6)]), 9, "s")
    assert text(rates.increase()) == want and rates.late_samples() == 2
    rates.process(frame([("m", "a", 3100, value["m", "a"] + 7), (None, None, 5, 1), ("m", "a", None, 3), ("m", "a", 3200, None)]), 10, "s")
    assert rates.increase().where("window_start >= timestamp_seconds(3000)").first()["increase"] == 7
    rates.tables.compact(fanout=2)
    assert rates.increase().agg(F.sum("increase")).first()[0] == ops.increase(frame(rows)).agg(F.sum("increase")).first()[0] + 7


def test_scans_prune_buckets(spark, tmp_path):
    root = f"{tmp_path}/landing"
    land(spark, root, "ledgers", ledger_rows([1, 2, 20_000, 40_000]))
    rows = landing.landed(spark, f"{root}/ledgers", schemas.LEDGERS)
    found = landing.read_ledgers(rows, 19_000, 21_000)
    assert seqs(found) == [20_000] and "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().executedPlan().toString()
    named = landing.LedgerSet.of(spark.createDataFrame([(N, 2), (N, 40_000), (N, 5)], "network string, ledger_sequence long"))
    assert sorted(named.buckets) == [0, 2] and seqs(landing.of_ledgers(rows, named)) == [2, 40_000]
    assert seqs(landing.of_ledgers(rows, landing.LedgerSet.of(named.frame.limit(0)))) == []
    assert landing.first_ledger(spark, f"{root}/ledgers", N) == 1 and landing.first_ledger(spark, f"{root}/none", N) is None


# faults of single operators


def test_a_chunk_with_missing_ledgers_is_not_walked(spark):
    ledgers = spark.createDataFrame(ledger_rows([k for k in range(1, 4001) if not 1500 <= k <= 1600]), schemas.LEDGERS)
    walks = walks_frame(spark, [(N, "C1", 1, 4000, False, None, ["events"])])
    chunks = history.plan_chunks(walks)
    rows = ledgers.select("network", F.lit("C1").alias("contract_id"), "ledger_sequence")
    assert [(r["chunk_from"], r["ledger_sequence"]) for r in history.broken_chunks(ledgers, chunks).collect()] == [(1, 1500)]
    _, after = history.walk_chunks(rows, chunks, ledgers, walks)
    assert walk_rows(after) == {"C1": (2000, False, None)}
    for gone, seen in ((4000, [(2001, 4000)]), (1, [(1, 1)]), (2001, [(2001, 2001)])):
        some = spark.createDataFrame(ledger_rows([k for k in range(1, 4001) if k != gone]), schemas.LEDGERS)
        assert [(r["chunk_from"], r["ledger_sequence"]) for r in history.broken_chunks(some, chunks).collect()] == seen
    assert history.broken_chunks(ledgers.limit(0), chunks).count() == 2


def test_gaps_at_the_ends_of_a_range(spark):
    ledgers = spark.createDataFrame([(N, k) for k in (5, 6, 9)], "network string, ledger_sequence long")
    found = lambda *bounds: sorted((r["from_sequence"], r["to_sequence"]) for r in integrity.sequence_gaps(ledgers, *bounds).collect())
    assert found() == [(7, 8)] and found(3, 12) == [(3, 4), (7, 8), (10, 12)] and found(6, 9) == [(7, 8)] and found(7) == [(7, 8)] and found(7, 8) == [(7, 8)]


def test_pages_of_accounts_are_in_the_order_of_accounts(spark):
    rows = spark.createDataFrame([("C1", f"G{100 - k}", 5000 * k) for k in range(12)], "contract_id string, account_id string, ledger_sequence long")
    found = paging.paginate_all(rows, ["contract_id"], ["account_id"], 3).orderBy("page").collect()
    ends = sorted(f"G{100 - k}" for k in range(12))
    assert [r["last_account_id"] for r in found] == ends[2::3]


def test_coverage_before_the_first_commit(spark):
    registered = spark.createDataFrame([(N, "C1", ["events"])], "network string, contract_id string, kinds array<string>")
    none = spark.createDataFrame([], "network string, cursor long")
    walks = walks_frame(spark, [(N, "C1", 1, 20, False, None, ["events"])])
    (row,) = coverage.coverage(registered, walks, none, "events", 1).collect()
    assert (row["derived"], row["from_ledger"], row["to_ledger"], row["pending"]) == (True, 21, 0, True)
    rows = spark.createDataFrame([], "network string, contract_id string, id string, ledger_sequence long, topic0 string")
    (row,) = reads.vouched(reads.events(rows, "C1"), registered, walks, none, "C1", "events").collect()
    assert (row["id"], row["to_ledger"], row["status"]) == (None, 0, "WAITING_FOR_LEDGERS")


def test_gaps_of_the_store_have_their_life_cycle(spark, tmp_path):
    live = Live(spark, f"{tmp_path}/landing", f"{tmp_path}/store", N)
    live.tables.commit({"gaps": gap(spark, 1000, 5499)})
    assert [(r["heal_next_to"], r["to_sequence"]) for r in integrity.list_open_gaps(live.gaps()).collect()] == [(5499, 5499)]
    healed = lambda to: live.gaps().select("id", F.lit(to).cast("long").alias("new_next_to"), F.current_timestamp().alias("healed_at"))
    for to, left in ((3499, [3499]), (999, [])):
        live.tables.commit({"gaps": history.advance_heal(live.gaps(), healed(to)).select(*live.gaps().columns)})
        assert [r["heal_next_to"] for r in integrity.list_open_gaps(live.gaps()).collect()] == left




def test_status_of_a_store(spark, tmp_path):
    root, at, store = f"{tmp_path}/landing", f"{tmp_path}/checkpoint", f"{tmp_path}/store"
    of = lambda **more: status(spark, root, store, N, **more).first().asDict()
    empty = of()
    assert (empty["cursor"], empty["next"], empty["tip"], empty["ready"], empty["alert"], empty["lag_seconds"], empty["counters"]) == (0, 1, 0, False, False, None, None)
    land_all(spark, root, [k for k in range(1, 21) if k not in (7, 8)])
    register(spark, root)
    assert (of()["tip"], of()["ready"]) == (20, False)
    live = Live(spark, root, store, N)
    live.start(at).awaitTermination()
    found = of(archive=UNVERIFIED)
    assert (found["cursor"], found["tip"], found["tip_lag"], found["lag_seconds"]) == (20, 20, 0, 0)
    assert (found["ready"], found["open_gaps"], found["alert"], found["archive"]) == (True, 1, True, UNVERIFIED)
    assert found["counters"] == live.tables.counters() and found["counters"]["suppressed_transfers"] > 0
    walker = Walker(spark, root, store, N, size=5)
    walker.request(requests(spark, [(N, "C1", 1, 20, ["events"])]))
    assert of()["pending_walks"] == 1
    # ledgers that land beyond the cursor are a lag until they are derived; a gap that lands is none any more
    then = datetime.now().replace(microsecond=0)
    rows = [(*r[:4], then) for r in ledger_rows(range(21, 31))]
    land_all(spark, root, [7, 8])
    land(spark, root, "ledgers", rows)
    assert (of()["tip_lag"], of()["ready"], of()["lag_seconds"]) == (10, False, 50)
    live.start(at).awaitTermination()
    late = of(now=then + timedelta(seconds=61))
    assert (late["cursor"], late["open_gaps"], late["ready"], late["lag_seconds"], late["alert"]) == (30, 0, True, 61, True)
    assert not of(now=then + timedelta(seconds=59))["alert"]


@pytest.mark.parametrize("most", [1, 9, 1_000_000])
def test_pages_of_text_keys_are_numbered_by_how_they_start(spark, monkeypatch, most):
    monkeypatch.setattr(paging, "MOST_SPANS", most)
    rng = random.Random(3)
    keys = [None, "", "\u00e9", "\U0001f600", "A", "AAAA", *("AAAA" + "".join(rng.choice("AB\u00e9\uffee\U0001f600") for _ in range(rng.randrange(9))) for _ in range(300))]
    rows = sorted({(c, k, d) for c in ("C1", "C2") for k in keys for d in ("persistent", "temporary") if rng.random() < 0.8}, key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode(), r[2]))
    frame = spark.createDataFrame(rows, "contract_id string, key_xdr string, durability string").repartition(5)
    want = {}
    for c in ("C1", "C2"):
        own = [r for r in rows if r[0] == c]
        want |= {(c, i // 7 + 1): (len(own[i : i + 7]), own[i : i + 7][-1][1:]) for i in range(0, len(own), 7)}
    got = paging.paginate_all(frame, ["contract_id"], ["key_xdr", "durability"], 7).collect()
    assert {(r["contract_id"], r["page"]): (r["n_rows"], (r["last_key_xdr"], r["last_durability"])) for r in got} == want
    n = frame.select(paging.spans(frame, ["contract_id"], ["key_xdr", "durability"]).alias("s")).distinct().count()
    assert n > 100 if most > 1000 else n < 10
