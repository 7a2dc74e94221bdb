"""Row-level derivations over requests, runs and mechanisms: narrow expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import flag, safe_ratio
from .design import CAUSE_LABELS, CAUSES

# The calibrated limits of the counted service levels, in seconds.
SLO_LIMITS = {
    "ttft_p95": 0.06512947314299491,
    "total_latency_p95": 0.26779416389490324,
    "post_first_token_duration_p95": 0.20162438542758712,
}
SLO_FLAGS = {
    "ttft_p95": "ttft_slo_violated",
    "total_latency_p95": "total_latency_slo_violated",
    "post_first_token_duration_p95": "decode_duration_slo_violated",
}
SLO_MARGINS = {
    "ttft_p95": "ttft_violation_margin",
    "total_latency_p95": "total_latency_violation_margin",
    "post_first_token_duration_p95": "decode_duration_violation_margin",
}


def derived_request_metrics(requests: DataFrame) -> DataFrame:
    """Queueing, first-token, service and decode durations; all null unless the request is timed."""
    c = F.col
    timed = c("actual_arrival").isNotNull() & c("dispatch_time").isNotNull() & c("completion_time").isNotNull()
    decode = c("completion_time") - c("first_token_time")
    columns = {
        "queue_delay": c("dispatch_time") - c("actual_arrival"),
        "ttft": c("first_token_time") - c("actual_arrival"),
        "service_time": c("completion_time") - c("dispatch_time"),
        "total_latency": c("completion_time") - c("actual_arrival"),
        "arrival_slip": c("actual_arrival") - c("scheduled_arrival"),
        "post_first_token_duration": decode,
        "observed_seconds_per_output_token": F.when(c("server_output_tokens") > 0, decode / c("server_output_tokens")),
    }
    return requests.withColumns({n: F.when(timed, e) for n, e in columns.items()})


def success_latencies(requests: DataFrame) -> DataFrame:
    """Latencies of successful requests; each needs only its own two timestamps. Rows are kept."""
    ok = F.col("status") == "success"
    return requests.withColumns({
        "ttft": F.when(ok, F.col("first_token_time") - F.col("actual_arrival")),
        "total_latency": F.when(ok, F.col("completion_time") - F.col("actual_arrival")),
        "post_first_token_duration": F.when(ok, F.col("completion_time") - F.col("first_token_time")),
        "success_completion": F.when(ok, F.col("completion_time")),
        **{f"ok_{n}": F.when(ok, F.col(n)) for n in ("server_prompt_tokens", "server_output_tokens", "dependency_duration")},
    })


def prefill_proxy() -> Column:
    """Model-side prefill time; a zero timestamp counts as missing, as in the recorded analyses."""
    c = F.col
    first = F.coalesce(F.nullif(c("llama_first_token_time"), F.lit(0.0)), c("first_token_time"))
    start = F.coalesce(F.nullif(c("llama_dispatch_time"), F.lit(0.0)), c("actual_arrival"))
    return first - start


def request_ordinal(request_id: Column) -> Column:
    return F.regexp_extract(request_id, r"-(\d+)$", 1).cast("bigint")


def cause_labels(active: Column) -> Column:
    """Causes named by a mechanism array, in fixed order."""
    return F.array_compact(F.array(*[F.when(F.array_contains(active, CAUSE_LABELS[c]), F.lit(c)) for c in CAUSES]))


def label_indicators(causes: Column) -> dict[str, Column]:
    return {f"label_{c}": F.array_contains(causes, c).cast("int") for c in CAUSES}


def set_key(causes: Column) -> Column:
    """Display key of a cause set, in fixed order; NONE when empty."""
    ordered = F.filter(F.array(*[F.lit(c) for c in CAUSES]), lambda c: F.array_contains(causes, c))
    return F.when(F.size(ordered) == 0, F.lit("NONE")).otherwise(F.array_join(ordered, "+"))


def set_key_from_indicators(prefix: str) -> Column:
    named = F.array_compact(F.array(*[F.when(F.col(f"{prefix}{c}") == 1, F.lit(c)) for c in CAUSES]))
    return F.when(F.size(named) == 0, F.lit("NONE")).otherwise(F.array_join(named, "+"))


def with_slo_flags(runs: DataFrame, limits: dict[str, float] = SLO_LIMITS) -> DataFrame:
    """Strict violations, margins, violation count and class. A missing metric is not a violation."""
    flags = {SLO_FLAGS[m]: flag(F.col(m) > F.lit(x)) for m, x in limits.items()}
    margins = {SLO_MARGINS[m]: (F.col(m) - F.lit(x)) / F.lit(x) for m, x in limits.items()}
    out = runs.withColumns({**flags, **margins})
    names = list(flags)
    out = out.withColumn("slo_violation_count", sum((F.col(n) for n in names[1:]), F.col(names[0])))
    return out.withColumn(
        "slo_violation_class",
        F.when(F.col("slo_violation_count") == 0, "NO_COUNTED_SLO_VIOLATION")
        .when(F.col("slo_violation_count") == 1, "SINGLE_SLO_VIOLATION")
        .otherwise("COMPOUND_SLO_VIOLATION"),
    )


def mechanism_magnitude(mechanism_type: Column, intensity: Column, delay_ms: Column) -> dict[str, Column]:
    return {
        "magnitude_value": F.when(mechanism_type == "downstream_latency", F.coalesce(delay_ms, intensity)).otherwise(intensity),
        "magnitude_unit": F.when(mechanism_type == "cpu_contention", "logical_cpu_worker_fraction")
        .when(mechanism_type == "downstream_latency", "ms").otherwise("intensity"),
    }


def verified_active_types(mechanisms: DataFrame, keys: list[str]) -> DataFrame:
    """Types of mechanisms that stopped with verified evidence, one row per (run, type)."""
    good = (F.col("verification_state") == "STOPPED") & F.coalesce(F.col("verified"), F.lit(False))
    return mechanisms.where(good).select(*keys, "mechanism_type").distinct()


def queue_confounded(family: Column, deferred_max: Column) -> Column:
    return family.isin("input", "output") & (F.coalesce(deferred_max, F.lit(0.0)) > 0)


def confound_state(valid: Column, family: Column, deferred_max: Column) -> Column:
    """State of a run by mechanism family; the spelling of the second state is the recorded one."""
    queued = F.coalesce(deferred_max, F.lit(0.0)) > 0
    return (
        F.when(~valid, "INVALID")
        .when(family.isin("input", "output") & queued, "CONFUNDED")
        .when((family == "downstream") & queued, "VALID_WITH_SECONDARY_EFFECT")
        .otherwise("VALID")
    )


def interval_text(mean: Column, low: Column, high: Column) -> Column:
    known = mean.isNotNull() & low.isNotNull() & high.isNotNull()
    return F.when(known, F.format_string("%.6g [%.6g, %.6g]", mean, low, high)).otherwise("")


def ratio_strength(highest: Column) -> Column:
    return (
        F.when(highest.isNull() | (highest < 1.10), "weak observed effect")
        .when(highest < 1.50, "moderate observed effect")
        .otherwise("strong observed effect")
    )


def degree_subsets(degree: Column, prefix: str = "") -> Column:
    """Names of the evaluation subsets a row belongs to."""
    return F.array_compact(F.array(
        F.lit(prefix + "ALL"), F.when(degree == 0, prefix + "CONTROL"),
        F.when(degree == 1, prefix + "SINGLE"), F.when(degree == 2, prefix + "COMPOUND"),
    ))


def token_realization(output: Column, target: Column) -> Column:
    return safe_ratio(output.cast("double"), target.cast("double"))
