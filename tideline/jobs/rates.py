"""Rates of counters over a stream of samples: the last sample of each series is state, kept in the commit with what it adds up to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ops
from ..sources.store import Store

SAMPLES = "metric string, labels string, ts timestamp, value bigint"
SERIES = ["metric", "labels"]
#: Seconds of a window. Part of the stored layout.
WINDOW = 300


def open_store(spark: SparkSession, root: str) -> Store:
    increments = ("metric string, labels string, window_start timestamp, part bigint, increase bigint", [*SERIES, "window_start", "part"])
    return Store(spark, root, {}, {"series": (SAMPLES, SERIES), "increments": increments})


@dataclass
class Rates:
    """Increase and rate of each counter in windows of five minutes, from samples that arrive in batches.

    A sample adds what its counter has gained since the one before it, in whichever batch that was; after a reset it
    adds all that the counter shows. A series' last sample and the increments of a batch are one commit, so that a batch
    that runs again adds nothing twice.

    Late samples: one that is not after the last sample of its series in earlier batches does not count by itself,
    since the counter was cumulative and the later sample holds what it held; only a reset between the two is lost.
    ``late_samples`` says how many there were. Samples of one batch may come in any order, and copies add nothing.
    """

    spark: SparkSession
    store: str

    def __post_init__(self) -> None:
        self.tables = open_store(self.spark, self.store)

    def process(self, batch: DataFrame, batch_id: int, stream: str | None = None) -> None:
        stream = stream or self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        with self.tables.pinned() as store:
            if store.is_committed(stream, batch_id):
                return
            last = store.read("series")
            known = last.select(*SERIES, F.col("ts").alias("_ts"))
            seen = Observation()
            samples = batch.select(F.coalesce("metric", F.lit("")).alias("metric"), F.coalesce("labels", F.lit("")).alias("labels"), "ts", F.col("value").cast("long").alias("value")).where("ts is not null and value is not null")
            late = F.coalesce(F.col("ts") <= F.col("_ts"), F.lit(False))
            samples = samples.join(known, SERIES, "left").withColumn("_late", late).observe(seen, F.count_if("_late").alias("late_samples"))
            samples = store.staged(samples.where("not _late").drop("_ts", "_late"), "samples")
            own = last.join(samples.select(*SERIES).distinct(), SERIES, "left_semi")
            gained = ops.increase(own.unionByName(samples), f"{WINDOW} seconds")
            increments = gained.select(*SERIES, "window_start", F.lit(max((r["version"] for r in store.log()), default=0) + 1).cast("long").alias("part"), "increase")
            ends = samples.groupBy(*SERIES).agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "value")).alias("_s")).select(*SERIES, "_s.ts", "_s.value")
            store.commit({"series": ends, "increments": increments}, stream, batch_id, counters=lambda: dict(seen.get))

    def increase(self) -> DataFrame:
        """What each counter gained in each window, over all batches."""
        return self.tables.read("increments").groupBy(*SERIES, "window_start").agg(F.sum("increase").alias("increase"))

    def rate(self) -> DataFrame:
        """Increase a second."""
        return self.increase().select(*SERIES, "window_start", (F.col("increase") / WINDOW).alias("rate"))

    def late_samples(self) -> int:
        return self.tables.counters().get("late_samples", 0)

    def start(self, samples: str, checkpoint: str, max_files: int = 1000) -> StreamingQuery:
        """Run over all sample files that have landed."""
        source = self.spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", max_files).parquet(samples)
        return source.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
