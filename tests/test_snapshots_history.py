import pytest

from tideline.functions import snake_case
from tideline.operators import coverage, history, integrity, paging, snapshots
from tideline.schemas import BACKFILL, GAPS
from tideline.sources import sinks
from tideline.sources.store import Store

CHANGE = "network string, contract_id string, key_xdr string, durability string, id string, ledger_sequence long, change_type string, post_value string"


def states(spark, *rows):
    return spark.createDataFrame([("n", "CAAA", k, "persistent", f"{i:030d}", led, kind, v) for i, (k, led, kind, v) in enumerate(rows)], CHANGE)


def only(df):
    (row,) = df.collect()
    return row


def test_older_ledgers_do_not_overwrite(spark):
    got = only(snapshots.state_snapshot(states(spark, ("kA", 200, "updated", "v200"), ("kA", 100, "updated", "v100"))))
    assert got["value"] == "v200"
    got = only(snapshots.state_snapshot(states(spark, ("kA", 200, "updated", "v200"), ("kA", 100, "updated", "v100"), ("kA", 300, "restored", "v300"))))
    assert (got["value"], got["deleted"]) == ("v300", False)


def test_tombstones_stay(spark):
    got = snapshots.state_snapshot(states(spark, ("kA", 300, "removed", None), ("kA", 100, "created", "v")))
    assert only(got)["deleted"] and snapshots.live_only(got).isEmpty()


def test_last_change_of_a_ledger_wins(spark):
    assert only(snapshots.state_snapshot(states(spark, ("kA", 400, "created", "v1"), ("kA", 400, "updated", "v2"))))["value"] == "v2"


def walk(spark, target, next_to, done=False, clamped=None, kinds=("events",)):
    return spark.createDataFrame([("n", "C", target, next_to, done, clamped, list(kinds))], BACKFILL)


def test_chunks(spark):
    got = history.plan_chunks(walk(spark, 1, 5000)).collect()
    assert [(r["chunk_from"], r["chunk_to"]) for r in got] == [(3001, 5000), (1001, 3000), (1, 1000)]


@pytest.mark.parametrize("next_to, wall, gap, after", [(3000, 1200, (1, 1199), (1199, True, 1200)), (800, 9000, (1, 800), (800, True, 801)), (3000, 1, None, (3000, False, None))])
def test_wall(spark, next_to, wall, gap, after):
    gaps, walks = history.clamp_at_wall(walk(spark, 1, next_to), spark.createDataFrame([("n", wall)], "network string, wall long"))
    assert [(g["from_sequence"], g["to_sequence"]) for g in gaps.collect()] == ([gap] if gap else [])
    row = only(walks)
    assert (row["next_to"], row["done"], row["clamped_at"]) == after


@pytest.mark.parametrize("oldest, want", [(1200, 1200), (2, 2), (3000, 3000), (5000, 3001)])
def test_retention_wall(spark, oldest, want):
    ledgers = spark.range(oldest, 5001).selectExpr("'n' as network", "id as ledger_sequence")
    assert only(integrity.retention_wall(ledgers, 2, 3000))["wall"] == want


REQUEST = "network string, contract_id string, target_from long, anchor long, kinds array<string>"
CASES = [
    ((100, 3000, False, ["events"]), (100, 5000, ["events"]), (100, 3000, False, ["events"])),
    ((100, 99, True, ["events"]), (1, 5000, ["events"]), (1, 99, False, ["events"])),
    ((100, 99, True, ["events"]), (100, 9000, ["events", "state"]), (100, 9000, False, ["events", "state"])),
    ((100, 99, True, ["events", "state"]), (100, 5000, ["events"]), (100, 99, True, ["events"])),
    ((100, 99, True, ["events"]), (100, 6000, ["events", "state"]), (100, 6000, False, ["events", "state"])),
]


@pytest.mark.parametrize("now, asked, want", CASES)
def test_reconcile(spark, now, asked, want):
    current = walk(spark, now[0], now[1], now[2], None, now[3])
    row = only(history.reconcile_backfill(current, spark.createDataFrame([("n", "C", *asked)], REQUEST)))
    assert (row["target_from"], row["next_to"], row["done"], row["covered_kinds"]) == want


def test_heal_and_unclamp(spark):
    walks, heals = walk(spark, 1000, 5499, True, 5500), "network string, to_sequence long, new_next_to long"
    row = only(history.unclamp(walks, spark.createDataFrame([("n", 5499, 3499)], heals)))
    assert (row["next_to"], row["clamped_at"]) == (3499, 5500)
    row = only(history.unclamp(walks, spark.createDataFrame([("n", 5499, 999)], heals)))
    assert (row["next_to"], row["clamped_at"]) == (999, None)
    gap = spark.createDataFrame([("g", "n", 1000, 5499, "retention", None, None, None)], GAPS)
    healed = lambda n: spark.createDataFrame([("g", n)], "id string, new_next_to long").selectExpr("*", "timestamp_seconds(1) healed_at")
    assert only(history.advance_heal(gap, healed(3499)))["resolved_at"] is None
    assert only(history.advance_heal(gap, healed(999)))["resolved_at"] is not None


def test_chain_and_reset(spark):
    rows = [("n", i, f"h{i}", "bad" if i == 103 else f"h{i - 1}") for i in range(101, 106)]
    ledgers = spark.createDataFrame(rows, "network string, ledger_sequence long, hash string, previous_hash string")
    assert [r["ledger_sequence"] for r in integrity.continuity_breaks(ledgers).collect()] == [103]
    cursors = spark.createDataFrame([("n", 4_000_000, 1_000), ("m", 1_000, 1_000)], "network string, cursor long, tip long")
    assert {r["network"]: r["reset"] for r in integrity.network_reset(cursors).collect()} == {"n": True, "m": False}


def test_gaps_across_buckets(spark):
    edge = 1 << 16
    ledgers = spark.createDataFrame([("n", x) for x in (1, 2, 5, edge - 1, edge + 3, 3 * edge)], "network string, ledger_sequence long")
    got = sorted((r["from_sequence"], r["to_sequence"]) for r in integrity.sequence_gaps(ledgers).collect())
    assert got == [(3, 4), (6, edge - 2), (edge, edge + 2), (edge + 4, 3 * edge - 1)]


def test_coverage_and_status(spark):
    regs = spark.createDataFrame([("n", "C", ["events", "state"])], "network string, contract_id string, kinds array<string>")
    cursors = spark.createDataFrame([("n", 6000)], "network string, cursor long")
    walks = walk(spark, 1, 999, True, 1000)

    def status(first, last):
        rows = coverage.coverage(regs, walks, cursors, "events", first, last).selectExpr("*", "false has_more", "6000 cursor", f"{first} first", f"{last} last")
        return only(coverage.scan_status(rows))

    assert status(2000, 3000)["status"] == "COMPLETE"
    row = status(10, 3000)
    assert (row["status"], row["clamped_at"]) == ("OLDEST_REACHED", 1000)
    assert status(10, 0)["status"] == "WAITING_FOR_LEDGERS"
    none = only(coverage.coverage(regs, walks, cursors, "transfers"))
    assert (none["derived"], none["from_ledger"], none["to_ledger"]) == (False, 0, 0)
    late = only(coverage.coverage(regs, walks, cursors, "state"))
    assert (late["from_ledger"], late["pending"]) == (6000, True)


def test_pages_keep_both_roles(spark):
    rows = spark.createDataFrame([("100", "recipient"), ("100", "sender"), ("200", "sender")], "transfer_id string, role string")
    seen, after = [], None
    while True:
        shown = paging.page(rows, ["transfer_id", "role"], 1, after).collect()
        seen += [(r["transfer_id"], r["role"]) for r in shown]
        if not shown[-1]["has_more"]:
            break
        after = seen[-1]
    assert seen == [("100", "recipient"), ("100", "sender"), ("200", "sender")]
    with pytest.raises(ValueError):
        paging.page(rows, ["transfer_id"], 1001)
    with pytest.raises(ValueError):
        paging.account_filter(rows, account="G", sender="G")


def test_keyset_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as string) a", "cast(id % 3 as string) b").write.parquet(f"{tmp_path}/t")
    plan = paging.keyset_after(spark.read.parquet(f"{tmp_path}/t"), ["a", "b"], ("4", "1"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan


def test_snake_case(spark):
    names = {"Transfer": "transfer", "FeeUpdated": "fee_updated", "NFTMinted": "nft_minted", "set_admin": "set_admin", "transfer": "transfer", "AuctionBid2": "auction_bid2", "": ""}
    rows = spark.createDataFrame(list(names.items()), "name string, want string").withColumn("got", snake_case(__import__("pyspark.sql.functions", fromlist=["col"]).col("name")))
    assert all(r["got"] == r["want"] for r in rows.collect())


def test_replay_is_a_no_op(spark):
    rows = spark.createDataFrame([("n", "C", "tx", 0, "a"), ("n", "C", "tx", 0, "b"), ("n", "C", "tx", 1, "c")], "network string, contract_id string, tx_hash string, event_index int, id string")
    key = sinks.IDEMPOTENCY["events"]
    first = sinks.new_rows(rows, rows.limit(0), key, ["id"])
    assert sorted(r["id"] for r in first.collect()) == ["a", "c"]
    assert sinks.new_rows(rows, first, key, ["id"]).isEmpty() and sinks.id_collisions(first, "events").isEmpty()


def test_uncommitted_batches_are_not_seen(spark, tmp_path):
    root, rows = f"{tmp_path}/store", spark.createDataFrame([("n", 1, "x")], "network string, ledger_sequence bigint, id string")
    store = Store(spark, root, {"t": "network string, ledger_sequence bigint, id string"}, {})
    assert store.read("t").isEmpty()
    store.commit({"t": rows}, "direct", 0)
    # a commit that died before its marker
    rows.selectExpr("*", "2L version", "0L bucket").write.partitionBy("bucket").parquet(f"{root}/t/attempt=000000000002-direct-1-dead")
    assert store.read("t").count() == 1
    store.commit({"t": rows}, "direct", 1)
    store.commit({"t": rows}, "direct", 1)  # two drivers that both finish: one attempt counts
    assert store.read("t").count() == 2
    store.commit({"t": rows}, "another checkpoint", 1)
    assert store.read("t").count() == 3
    store.compact(fanout=3)
    assert len(store.log()) == 1 and store.read("t").count() == 3
    assert store.is_committed("direct", 1) and not store.is_committed("direct", 2)


def test_feed_equivalence_compares_every_transaction_and_change(spark):
    schema = "network string, ledger_sequence long, tx_hash string, component string, canonical string"
    rows = [("net", k, tx, c, f"{k}{tx}{c}{n}") for k in range(1, 7) for tx in (None, "t1", "t2") for c in ("1_header", "2_result", "3_changes") for n in range(5)]
    other = list(reversed(rows))
    other.remove(("net", 2, "t2", "3_changes", "2t23_changes4"))  # the last change of the second transaction
    other.append(("net", 3, None, "2_result", "3None2_result0"))  # twice
    at = other.index(("net", 4, None, "1_header", "4None1_header2"))
    other[at] = (*other[at][:4], None)
    other = [(n, k, {"t1": "t2", "t2": "t1"}.get(tx, tx) if k == 5 else tx, c, x) for n, k, tx, c, x in other]  # swapped
    got = integrity.feed_equivalence(spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)).collect()
    assert sorted((r["ledger_sequence"], r["first_difference"]) for r in got) == [(2, "3_changes"), (3, "2_result"), (4, "1_header"), (5, "1_header")]


def test_feed_equivalence_shuffles_rows_by_component_and_not_by_change(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n, tasks = 30_000, 4
        row = lambda text: spark.range(0, n, 1, tasks).selectExpr("'net' network", "id % 3 ledger_sequence", "cast(id % 1000 as string) tx_hash", "'1_header' component", text)
        got = integrity.feed_equivalence(row("cast(id as string) canonical"), row("if(id = 7, 'x', cast(id as string)) canonical"))
        plan = got._jdf.queryExecution().executedPlan()
        assert [(r["ledger_sequence"], r["first_difference"]) for r in got.collect()] == [(1, "1_header")]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    moved, left = [], [plan]
    while left:
        node = left.pop()
        left += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Exchange":
            moved.append(node.metrics().apply("shuffleRecordsWritten").value())
    assert moved and 0 < max(moved) <= 2 * tasks * 3


def test_feed_equivalence_tells_nulls_and_joined_texts_apart(spark):
    schema = "network string, ledger_sequence long, tx_hash string, component string, canonical string"
    one = [(None, "x"), ("-", "x"), ("1:a", "b"), ("a", None), (None, None), ("", "")]
    two = [("", "x"), (None, "-x"), ("1", ":ab"), ("a", "-"), ("-", None), (None, "")]
    frame = lambda texts: spark.createDataFrame([("net", k, tx, "1_header", c) for k, (tx, c) in enumerate(texts)], schema)
    assert integrity.feed_equivalence(frame(one), frame(one)).isEmpty()
    assert integrity.feed_equivalence(frame(one), frame(two)).count() == len(one)
    assert integrity.feed_equivalence(frame(one), frame([])).count() == len(one)
