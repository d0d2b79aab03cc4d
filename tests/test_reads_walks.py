import json

import pytest
from pyspark.sql import functions as F

from tideline import schemas
from tideline.operators import history, integrity, ops, paging
from tideline.plans import reads
from tideline.sources import landing

WALK = "network string, contract_id string, target_from long, next_to long, done boolean, clamped_at long, covered_kinds array<string>"


def setting(spark):
    registered = spark.createDataFrame([("n", "C1", ["events"])], "network string, contract_id string, kinds array<string>")
    walks = spark.createDataFrame([("n", "C1", 1, 50, False, None, ["events"])], WALK)
    cursors = spark.createDataFrame([("n", 100)], "network string, cursor long")
    rows = spark.createDataFrame([("n", "C1", f"{k:03d}", k, None) for k in range(60, 70)], "network string, contract_id string, id string, ledger_sequence long, topic0 string")
    return registered, walks, cursors, rows


def test_an_empty_page_says_why_and_an_unknown_contract_is_an_error(spark):
    registered, walks, cursors, rows = setting(spark)
    ask = lambda **b: reads.vouched(reads.events(rows, "C1", **b), registered, walks, cursors, "C1", "events", b.get("first", 1), b.get("last", 0)).collect()
    assert {(r["status"], r["from_ledger"], r["to_ledger"], r["pending"]) for r in ask(limit=3)} == {("HAS_MORE", 51, 100, True)}
    for bounds, status in (({"first": 80, "last": 90}, "COMPLETE"), ({"first": 10, "last": 40}, "OLDEST_REACHED"), ({"first": 80}, "WAITING_FOR_LEDGERS")):
        (row,) = ask(**bounds)
        assert (row["id"], row["contract_id"], row["status"], row["has_more"]) == (None, "C1", status, False)
    with pytest.raises(reads.UnknownContract):
        reads.vouched(reads.events(rows, "C2"), registered, walks, cursors, "C2", "events")


def test_resume_keys_lead_through_all_pages(spark):
    rows = setting(spark)[3]
    seen, after, limit = [], None, 4
    while True:
        shown = reads.events(rows, "C1", limit=limit, after=after)
        found = shown.collect()
        if not found:
            break
        seen += [r["id"] for r in found]
        text = paging.resume_key(shown, "events", "n", "C1", limit, ["id"], snapshot=False, first=1).first()["resume_key"]
        limit, after, filters = paging.read_resume_key(text, "events", "n", "C1", ["id"])
        assert (limit, filters) == (4, {"first": 1})
    assert seen == [f"{k:03d}" for k in range(60, 70)]
    good = json.loads(text)
    for wrong in ({"version": 2}, {"endpoint": "state"}, {"network": "m"}, {"contract": "C2"}, {"limit": 0}, {"limit": 1001}, {"limit": "9"}, {"last": {}}):
        with pytest.raises(ValueError):
            paging.read_resume_key(json.dumps({**good, **wrong}), "events", "n", "C1", ["id"])
    for text in ("", "[]", "{", "null"):
        with pytest.raises(ValueError):
            paging.read_resume_key(text, "events", "n", "C1", ["id"])


def test_walks_stop_above_a_broken_chunk(spark):
    walks = spark.createDataFrame([("n", "C1", 1, 5000, False, None, ["events"]), ("n", "C2", 4000, 5000, False, None, ["events"])], WALK)
    ledgers = spark.range(1, 5001).select(F.lit("n").alias("network"), F.col("id").alias("ledger_sequence"), F.concat(F.lit("h"), "id").alias("hash"), F.concat(F.lit("h"), F.when(F.col("id") == 1500, 0).otherwise(F.col("id") - 1)).alias("previous_hash"))
    rows = ledgers.select("network", F.lit("C1").alias("contract_id"), "ledger_sequence")
    chunks = history.plan_chunks(walks)
    assert [(r["contract_id"], r["chunk_from"], r["ledger_sequence"]) for r in history.broken_chunks(ledgers, chunks).collect()] == [("C1", 1001, 1500)]
    taken, after = history.walk_chunks(rows, chunks, ledgers, walks)
    assert taken.agg(F.min("ledger_sequence"), F.max("ledger_sequence"), F.count("*")).first() == (3001, 5000, 2000)
    assert {r["contract_id"]: (r["next_to"], r["done"]) for r in after.collect()} == {"C1": (3000, False), "C2": (3999, True)}


def test_progress_of_a_vanished_walk_is_refused_and_a_clamp_travels(spark):
    walks = spark.createDataFrame([("n", "C1", 1, 50, False, None, ["events"])], WALK)
    progress = spark.createDataFrame([("n", "C1", 20, 21)], "network string, contract_id string, new_next_to long, clamped_at long")
    row = history.advance_backfill(walks, progress).first()
    assert (row["next_to"], row["done"], row["clamped_at"]) == (20, True, 21)
    with pytest.raises(history.WalkVanished):
        history.advance_backfill(walks, progress.withColumn("contract_id", F.lit("C9")))


def test_counters_go_on_over_days_and_by_label(spark):
    rows = [("m", label, day * 86_400 + 10 * k, 100 * day + 10 * k + extra) for label, extra in (("a", 0), (None, 5)) for day in (0, 1, 4) for k in range(3)] + [("m", "a", 4 * 86_400 + 100, 3)]
    samples = spark.createDataFrame(rows, "metric string, labels string, at long, value long").withColumn("ts", F.timestamp_seconds("at"))
    total = {r["labels"]: r["n"] for r in ops.deltas(samples).groupBy("labels").agg(F.sum("delta").alias("n")).collect()}
    assert total == {"a": 420 + 3, "": 420}


def test_ledgers_as_a_stream(spark, tmp_path):
    rows = [("n", k, f"h{k}", f"h{k - 1}", None) for k in range(6)]
    spark.createDataFrame(rows, schemas.LEDGERS).repartition(2).write.parquet(f"{tmp_path}/ledgers")
    got = []
    stream = landing.stream_ledgers(spark, f"{tmp_path}/ledgers", max_files=1)
    take = lambda batch, _: got.extend(r["ledger_sequence"] for r in batch.collect())
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == list(range(6))
    assert [r["ledger_sequence"] for r in landing.static_snapshot(spark.createDataFrame([("n", "C1"), ("n", "C2")], "network string, contract_id string").withColumn("ledger_sequence", F.lit(1)), "C1").collect()] == [1]


def test_record_gaps_twice_is_a_no_op(spark):
    found = spark.createDataFrame([("g1", "n", 1, 2, "r")], "id string, network string, from_sequence long, to_sequence long, reason string")
    once = integrity.record_gaps(found.limit(0), found)
    assert integrity.record_gaps(once, found).count() == 1
