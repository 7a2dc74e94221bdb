"""Trace spans from request timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import computed_once


def short_id(length: int, *parts: Column | str) -> Column:
    """Deterministic hex id: leading digits of the SHA-256 of the joined parts."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, length)


def expand_spans(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Root, dependency and model span of every request with complete gateway timing."""
    c = F.col
    keep = [k for k in ["event_id"] if k in requests.columns]
    times = ["gateway_receive_time", "gateway_completion_time", "dependency_start_time", "dependency_end_time", "llama_dispatch_time"]
    timed = computed_once(requests.select(*keys, *keep, "request_id", *times)).where(
        c("gateway_receive_time").isNotNull() & c("dependency_start_time").isNotNull() & c("dependency_end_time").isNotNull()
        & c("llama_dispatch_time").isNotNull() & c("gateway_completion_time").isNotNull()
    )
    # Only names are exploded; everything else is a column of its own, so unused ids are never hashed.
    names = ["gateway request", "dependency call", "llama call"]
    rows = timed.select(
        *keys, *keep, "request_id", *times, short_id(32, c("request_id"), "trace").alias("trace_id"),
        short_id(16, c("request_id"), names[0]).alias("_root"), F.explode(F.array(*[F.lit(n) for n in names])).alias("span_name"))
    root, dependency = c("span_name") == names[0], c("span_name") == names[1]
    start = F.when(root, c("gateway_receive_time")).when(dependency, c("dependency_start_time")).otherwise(c("llama_dispatch_time"))
    end = F.when(dependency, c("dependency_end_time")).otherwise(c("gateway_completion_time"))
    return rows.select(
        *keys, *keep, "trace_id", F.when(root, c("_root")).otherwise(short_id(16, c("request_id"), c("span_name"))).alias("span_id"),
        F.when(~root, c("_root")).alias("parent_span_id"), "span_name", start.alias("start_time"), end.alias("end_time"),
        (end - start).alias("duration"), F.lit("ok").alias("status"),
        F.concat(F.lit('{"request_id":"'), c("request_id"), F.lit('"}')).alias("attributes"))
