import pytest
from pyspark.sql import functions as F

from tideline import schemas
from tideline.operators import extract

BIG = "170141183460469231731687303715884105727"
F_, T, W, O = "GFROM", "GTO", "CWATCHED", "COTHER"  # noqa: E741


def sym(name):
    return ("symbol", name, "b64")


def addr(a):
    return ("address", a, "b64")


ASSET = ("string", "native", "b64")


def i128(v):
    return ("i128", str(v), None, "b64")


def amount_map(**entries):
    return ("map", None, [(("symbol", k), v) for k, v in entries.items()], "b64")


def raw(spark, events, contract=W, successful=True):
    rows = [("net", 12345, None, 1, "tx", 0, i, "contract", contract, 0, list(topics), value, "raw") for i, (topics, value) in enumerate(events)]
    return spark.createDataFrame(rows, schemas.RAW_EVENTS)


def envelopes(df):
    return extract.event_envelope(extract.contract_events_only(extract.event_index(df)))


def regs(spark, **kinds):
    return spark.createDataFrame([("net", c, "admin", k, None) for c, k in kinds.items()], schemas.REGISTRATIONS)


ROLES = [
    ([sym("transfer"), addr(F_), addr(T), ASSET], i128(5000), (F_, T, "5000", None)),
    ([sym("transfer"), addr(F_), addr(T), ASSET], amount_map(amount=("i128", "42"), to_muxed_id=("u64", "777")), (F_, T, "42", "777")),
    ([sym("transfer"), addr(F_), addr(T)], i128(2**64), (F_, T, str(2**64), None)),
    ([sym("mint"), addr(F_), addr(T), ASSET], i128(9), (None, T, "9", None)),
    ([sym("mint"), addr(T), ASSET], i128(9), (None, T, "9", None)),
    ([sym("burn"), addr(F_), ASSET], i128(9), (F_, None, "9", None)),
    ([sym("clawback"), addr(F_), addr(T), ASSET], i128(9), (T, None, "9", None)),
    ([sym("clawback"), addr(T), ASSET], i128(9), (T, None, "9", None)),
    ([sym("transfer"), addr(F_), addr(T)], amount_map(amount=("i128", BIG), to_muxed_id=("bytes", "AQ8=")), (F_, T, BIG, "010f")),
]


def test_roles(spark):
    got = extract.decoded(envelopes(raw(spark, [(t, v) for t, v, _ in ROLES]))).orderBy("event_index").collect()
    assert [(r["from"], r["to"], r["amount"], r["to_muxed_id"]) for r in got] == [want for *_, want in ROLES]


HOSTILE = [
    ([sym("transfer"), addr(F_), addr(T)], i128(-1)),
    ([sym("transfer"), addr(F_)], i128(1)),
    ([sym("mint"), ASSET], i128(1)),
    ([sym("transfer"), addr(F_), addr(T)], amount_map(to_muxed_id=("u64", "1"))),
    ([sym("transfer"), addr(F_), addr(T)], amount_map(amount=("i128", "1"), other=("u64", "1"))),
    ([sym("transfer"), addr(F_), addr(T)], ("string", "1", None, "b64")),
    ([sym("transfer"), addr(F_), ("u64", "1", "b64"), addr(T)], i128(1)),
]


def test_hostile_rows_are_counted_and_kept(spark):
    events = envelopes(raw(spark, HOSTILE))
    assert extract.decoded(events).count() == 0
    tx = spark.createDataFrame([("net", 12345, None, 1, "tx", True, True)], schemas.TRANSACTIONS)
    audit = extract.extraction_audit(tx, events, regs(spark, **{W: ["transfers", "events"]})).first()
    assert audit["suppressed_transfers"] == len(HOSTILE) and audit["foreign_undecodable"] == 0
    assert events.count() == len(HOSTILE)


def test_other_names_are_routine(spark):
    assert extract.decode_transfers(envelopes(raw(spark, [([sym("approve"), addr(F_)], i128(5)), ([], i128(5))]))).count() == 0


def test_foreign_undecodable(spark):
    events = envelopes(raw(spark, [([sym("transfer"), addr(F_), addr(W)], i128(-5))], contract=O))
    tx = spark.createDataFrame([("net", 12345, None, 1, "tx", True, True)], schemas.TRANSACTIONS)
    audit = extract.extraction_audit(tx, events, regs(spark, **{W: ["movements"]})).first()
    assert (audit["suppressed_transfers"], audit["foreign_undecodable"]) == (0, 1)


@pytest.mark.parametrize(
    "topics, kinds, want",
    [
        ([addr(F_), addr(W)], ["movements"], [("recipient", F_)]),
        ([addr(W), addr(T)], ["movements"], [("sender", T)]),
        ([addr(W), addr(W)], ["movements"], [("recipient", W), ("sender", W)]),
        ([addr(F_), addr(T)], ["movements"], []),
        ([addr(F_), addr(W)], ["events"], []),
    ],
)
def test_movements(spark, topics, kinds, want):
    transfers = extract.decoded(envelopes(raw(spark, [([sym("transfer"), *topics], i128(7))], contract=O)))
    rows = extract.attribute_movements(transfers, regs(spark, **{W: kinds})).collect()
    assert sorted((r["role"], r["counterparty"]) for r in rows) == want
    assert all(r["contract_id"] == W and r["token_contract_id"] == O for r in rows)


def test_index_counts_dropped_events(spark):
    rows = raw(spark, [([sym("a")], i128(1)), ([sym("b")], i128(1))]).withColumn("event_type", F.when(F.col("pos_in_op") == 0, "diagnostic").otherwise("contract"))
    got = envelopes(rows).collect()
    assert [r["event_index"] for r in got] == [1] and len(got[0]["id"]) == 30


def test_failed_transactions_contribute_nothing(spark):
    tx = spark.createDataFrame([("net", 12345, None, 1, "tx", False, True)], schemas.TRANSACTIONS)
    assert extract.successful_only(raw(spark, [([sym("a")], i128(1))]), tx).count() == 0


def test_unresolvable_trustlines_are_counted_and_kept(spark):
    side = lambda asset, kind="credit": (None, None, None, None, "G1", asset, kind, 5, 9, 0)
    made = [side("A1"), side("A2"), side("A2"), side(None), side("A2", "pool_share"), side("A3"), None]
    rows = [("net", 12345 + (k == 2), None, 1, "tx", 0, k, "trustline", "created", None, x) for k, x in enumerate(made)]
    changes = extract.change_index(spark.createDataFrame(rows, schemas.RAW_CHANGES))
    assets = spark.createDataFrame([("net", "A1", "S1"), ("net", "A3", "S3")], "network string, asset string, contract_id string")
    registered = regs(spark, S1=["trustlines"], S3=["events"])
    assert [(r["asset"], r["contract_id"]) for r in extract.derive_trustline_changes(changes, assets, registered).collect()] == [("A1", "S1")]
    lines = extract.attributed_trustlines(changes, assets, registered).collect()
    assert sorted((r["ledger_sequence"], r["change_index"], r["reject_reason"] or "") for r in lines) == [(12345, 0, ""), (12345, 1, "asset"), (12345, 2, "asset"), (12346, 0, "asset")]
    tx = spark.createDataFrame([("net", 12345, None, 1, "tx", True, True)], schemas.TRANSACTIONS)
    audit = extract.extraction_audit(tx, envelopes(raw(spark, [([sym("a")], i128(1))])), registered, changes, assets).collect()
    assert {r["ledger_sequence"]: r["suppressed_trustlines"] for r in audit} == {12345: 2, 12346: 1}


def test_audit_reads_events_once_and_counts_each_once(spark, tmp_path):
    other_version = F.when(F.col("pos_in_op") >= 3, 1).otherwise(0)
    bad = [sym("transfer"), addr("C1"), addr("C2"), ("u64", "1", "b64")]
    made = [(bad, i128(1)), ([sym("transfer"), addr("C1"), addr("C3")], i128(1)), ([sym("mint"), addr(F_)], i128(-1)), ([sym("a")], i128(1)), (bad, i128(1))]
    rows = None
    for contract in (W, O):
        part = envelopes(raw(spark, made, contract).withColumn("body_version", other_version).withColumn("tx_index", F.lit(1 + (contract == O))))
        rows = part if rows is None else rows.unionByName(part)
    rows.coalesce(1).write.parquet(f"{tmp_path}/events")
    tx = spark.createDataFrame([("net", 12345, None, 1, "tx", True, True), ("net", 12346, None, 1, "ty", False, True)], schemas.TRANSACTIONS)
    registered = regs(spark, **{W: ["transfers", "events"], "C1": ["movements"], "C2": ["movements", "events"]})
    twice = registered.unionByName(registered)
    audit = extract.extraction_audit(tx, spark.read.parquet(f"{tmp_path}/events"), twice)
    assert audit._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    got = {r["ledger_sequence"]: r.asDict() for r in audit.collect()}
    assert [got[12345][c] for c in ("suppressed_events", "suppressed_transfers", "foreign_undecodable")] == [2, 2, 1]
    assert got[12346]["failed_txs"] == 1 and sum(got[12346][c] for c in ("suppressed_txs", "suppressed_events", "suppressed_transfers", "foreign_undecodable")) == 0
