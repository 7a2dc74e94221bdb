"""Streaming monitors. Each takes and returns DataFrames and works on batch frames too, so the batch
twin is the same code. State is bounded by watermarks. Monitors that need events in order are in ``stateful``."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .stateful import state_store


#: Accuracy of the quantile summaries in window state.
SUMMARY = 10_000


def run_available(stream: DataFrame) -> DataFrame:
    """Process what is available in append mode into a written table, and read that table."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    with state_store(spark):
        q = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def slo_windows(requests: DataFrame, ts: str, keys: Sequence[str], limit: float, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Requests, violations and latency per window.

    p95_latency is a latency of the window: the state holds a mergeable quantile summary of at most some thousand values,
    whatever the window, and the rank of the value returned is within n / SUMMARY of the exact one for n latencies (exact
    up to SUMMARY latencies).
    """
    lat = F.col("completion_time") - F.col("actual_arrival")
    timed = requests.withColumn("_lat", F.when(F.col("status") == "success", lat)).withWatermark(ts, delay)
    out = timed.groupBy(F.window(ts, width).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("_lat") > limit).alias("violations"), F.max("_lat").alias("max_latency"),
        F.percentile_approx("_lat", 0.95, SUMMARY).alias("p95_latency"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "requests", "violations", "max_latency", "p95_latency")


def deduplicate(rows: DataFrame, ts: str, ids: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """First occurrence of each id; state is dropped once the watermark passes."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(ids))


def late_timing(requests: DataFrame, timings: DataFrame, key: str, ts: str, timing_ts: str, wait: str = "1 second", delay: str = "10 minutes") -> DataFrame:
    """Requests with the timing that arrives within ``wait``; unmatched ones follow once the bound has passed."""
    left = requests.withWatermark(ts, delay)
    right = timings.withColumnRenamed(key, "_key").withWatermark(timing_ts, delay)
    near = (F.col(timing_ts) >= F.col(ts)) & (F.col(timing_ts) <= F.col(ts) + F.expr(f"interval {wait}"))
    out = left.join(right, (F.col(key) == F.col("_key")) & near, "leftOuter")
    return out.withColumn("resolved", F.col("_key").isNotNull().cast("int")).drop("_key")


def drift(samples: DataFrame, windows: DataFrame, keys: Sequence[str], observed: str, tolerance: float) -> DataFrame:
    """Samples inside an active window whose value strays from the expected one. The windows are a
    static table; the join is on the run key."""
    w = windows.select(*keys, "active_from", "active_to", "expected")
    inside = (F.col("actual_arrival") >= F.col("active_from")) & (F.col("actual_arrival") <= F.col("active_to"))
    return samples.join(w, list(keys)).where(inside & (F.abs(F.col(observed) - F.col("expected")) > tolerance))
