"""Operational rollups over counter samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

READY_WITHIN, LAG_SECONDS, DAY = 6, 60, 86_400


def _series(samples: DataFrame) -> list[str]:
    """What tells counters apart: the metric and, where samples have them, its labels."""
    return ["metric", *(["labels"] if "labels" in samples.columns else [])]


def deltas(samples: DataFrame) -> DataFrame:
    """What each counter sample added; after a reset, all that the counter shows.

    Samples are compared within days; a day's first sample is compared with the last one of the day before it that
    has any, of which there is one row a day.
    """
    key = _series(samples)
    rows = samples.na.fill("", key).withColumn("_day", F.expr(f"unix_seconds(ts) div {DAY}"))
    inside = rows.withColumn("_before", F.lag("value").over(W.partitionBy(*key, "_day").orderBy("ts", "value")))
    ends = rows.groupBy(*key, "_day").agg(F.max_by("value", F.struct("ts", "value")).alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(W.partitionBy(*key).orderBy("_day")))
    found = inside.join(ends, [*key, "_day"]).withColumn("_before", F.coalesce("_before", "_end")).where("_before is not null")
    return found.select(*key, "ts", F.when(F.col("value") >= F.col("_before"), F.col("value") - F.col("_before")).otherwise(F.col("value")).alias("delta"))


def increase(samples: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Sum of what each counter added in each window."""
    key = _series(samples)
    rows = deltas(samples).groupBy(*key, F.window("ts", window).alias("_w")).agg(F.sum("delta").alias("increase"))
    return rows.select(*key, F.col("_w.start").alias("window_start"), "increase")


def rate(samples: DataFrame, seconds: int = 300) -> DataFrame:
    """Increase a second."""
    return increase(samples, f"{seconds} seconds").select(*_series(samples), "window_start", (F.col("increase") / seconds).alias("rate"))


def quantiles(samples: DataFrame, exact: bool = False) -> DataFrame:
    """Median and 99th percentile of each metric."""
    found = F.percentile("value", F.array(F.lit(0.5), F.lit(0.99))) if exact else F.percentile_approx("value", F.array(F.lit(0.5), F.lit(0.99)))
    return samples.groupBy("metric").agg(found.alias("_q")).select("metric", F.col("_q")[0].alias("p50"), F.col("_q")[1].alias("p99"))


def status(rows: DataFrame) -> DataFrame:
    """One row for each network (next, tip, lag_seconds, open_gaps, pending_walks) with readiness and alert."""
    return rows.withColumns(
        {
            "tip_lag": F.greatest(F.col("tip") - F.col("next") + 1, F.lit(0)),
            "ready": F.col("next") + READY_WITHIN >= F.col("tip"),
            "alert": (F.col("lag_seconds") >= LAG_SECONDS) | (F.col("open_gaps") != 0),
        }
    )
