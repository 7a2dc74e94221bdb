"""Queries over requests, spans and metrics, up to run-level tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import safe_ratio
from ..operators import derive as D
from ..operators import runs as R
from ..operators.design import conditions
from ..sources.driver_views import RUN
from . import tables as V
from .oracle import RUN as RUN_SQL
from .registry import query

_TIMED = "actual_arrival IS NOT NULL AND dispatch_time IS NOT NULL AND completion_time IS NOT NULL"


@query(
    "request_derived_metrics", "P1 P9 P10 P11 P14",
    f"""SELECT request_id, event_id, CASE WHEN {_TIMED} THEN dispatch_time - actual_arrival END AS queue_delay,
    CASE WHEN {_TIMED} THEN first_token_time - actual_arrival END AS ttft,
    CASE WHEN {_TIMED} THEN completion_time - dispatch_time END AS service_time,
    CASE WHEN {_TIMED} THEN completion_time - actual_arrival END AS total_latency,
    CASE WHEN {_TIMED} THEN actual_arrival - scheduled_arrival END AS arrival_slip,
    CASE WHEN {_TIMED} THEN completion_time - first_token_time END AS post_first_token_duration,
    CASE WHEN {_TIMED} AND server_output_tokens > 0 THEN (completion_time - first_token_time) / server_output_tokens END AS observed_seconds_per_output_token,
    coalesce(nullif(llama_first_token_time, 0), first_token_time) - coalesce(nullif(llama_dispatch_time, 0), actual_arrival) AS prefill_proxy,
    sequence AS ordinal,
    CASE WHEN output_tokens <> 0 THEN server_output_tokens / output_tokens::DOUBLE END AS token_fraction FROM req""",
    "queue_delay ttft service_time total_latency arrival_slip post_first_token_duration observed_seconds_per_output_token prefill_proxy token_fraction",
)
def request_derived_metrics(spark, sf):
    df = D.derived_request_metrics(V.requests(spark, sf))
    return df.select(
        "request_id", "event_id", "queue_delay", "ttft", "service_time", "total_latency", "arrival_slip", "post_first_token_duration",
        "observed_seconds_per_output_token", D.prefill_proxy().alias("prefill_proxy"),
        D.request_ordinal(F.col("request_id")).alias("ordinal"),
        safe_ratio(F.col("server_output_tokens").cast("double"), F.col("output_tokens").cast("double")).alias("token_fraction"),
    )


_RUN_DOUBLES = (
    "ttft_p95 total_latency_p95 post_first_token_duration_p95 ttft_median total_latency_median post_first_token_duration_median "
    "scheduler_slip_p95 successful_requests_per_second completion_fraction server_prompt_tokens_median server_prompt_tokens_p95 "
    "server_output_tokens_median server_output_tokens_p95 dependency_duration_median dependency_duration_p95 requests_processing_max "
    "requests_processing_median requests_deferred_max requests_deferred_median host_cpu_median host_cpu_p95 server_cpu_median "
    "server_cpu_p95 server_rss_median server_rss_max"
)
_RUN_COUNTS = "successful_requests failed_requests admission_failed measured_request_count trace_row_count"
_RUN_FLAGS = "ttft_slo_violated total_latency_slo_violated decode_duration_slo_violated slo_violation_count slo_violation_class"


@query(
    "run_metrics_wide", "A1 A2 A4 A7 A8 P2 P6 P8",
    f"SELECT {RUN_SQL}, {', '.join((_RUN_DOUBLES + ' ' + _RUN_COUNTS + ' ' + _RUN_FLAGS).split())} FROM runs", _RUN_DOUBLES,
)
def run_metrics_wide(spark, sf):
    return V.runs(spark, sf).select(*RUN, *_RUN_DOUBLES.split(), *_RUN_COUNTS.split(), *_RUN_FLAGS.split())


_COMPACT = "ttft_p95 total_latency_p95 post_first_token_duration_p95 scheduler_slip_p95 successful_requests_per_second completion_fraction"


@query(
    "run_metrics_compact", "A5 A7",
    f"SELECT {RUN_SQL}, measured_request_count AS planned_requests, successful_requests, failed_requests, admission_failed, {', '.join(_COMPACT.split())} FROM reqagg",
    _COMPACT,
)
def run_metrics_compact(spark, sf):
    return R.compact_run_metrics(V.requests(spark, sf))


@query(
    "pilot_summary", "A6 P11 P12 P13",
    f"""SELECT {RUN_SQL}, l.seconds_per_output_token_median, l.token_realization_floor, l.token_realization_median, l.scheduler_slip_median, l.actual_arrival_rate,
    host_cpu_median, requests_deferred_max, server_output_tokens_median FROM runs0 JOIN (
      SELECT {RUN_SQL}, median(post_first_token_duration / nullif(server_output_tokens, 0)) AS seconds_per_output_token_median,
      quantile_cont(server_output_tokens / target_output_tokens::DOUBLE, 0.05) AS token_realization_floor,
      median(server_output_tokens / target_output_tokens::DOUBLE) AS token_realization_median, median(scheduler_slip) AS scheduler_slip_median,
      CASE WHEN count(actual_arrival) > 1 AND max(actual_arrival) > min(actual_arrival) THEN (count(actual_arrival) - 1) / (max(actual_arrival) - min(actual_arrival)) END AS actual_arrival_rate
      FROM lat JOIN cond USING (condition_id) GROUP BY {RUN_SQL}) l USING ({RUN_SQL})""",
    "seconds_per_output_token_median token_realization_floor token_realization_median scheduler_slip_median actual_arrival_rate host_cpu_median requests_deferred_max server_output_tokens_median",
)
def pilot_summary(spark, sf):
    targets = V.runs(spark, sf).select(*RUN).join(F.broadcast(conditions(spark).select("condition_id", "target_output_tokens")), "condition_id")
    out = R.pilot_run_summary(V.requests(spark, sf), V.system(spark, sf), V.runtime(spark, sf), targets)
    return out.select(*RUN, "seconds_per_output_token_median", "token_realization_floor", "token_realization_median", "scheduler_slip_median",
                      "actual_arrival_rate", "host_cpu_median", "requests_deferred_max", "server_output_tokens_median")


@query(
    "long_metric_extract", "A8",
    f"SELECT {RUN_SQL}, requests_deferred_max, requests_processing_max, requests_deferred_median, requests_processing_median FROM qagg",
    "requests_deferred_max requests_processing_max requests_deferred_median requests_processing_median",
)
def long_metric_extract(spark, sf):
    return R.queue_aggregates(V.runtime(spark, sf)).drop("runtime_queue_metrics_unavailable_reason")


@query(
    "wide_metric_guard", "A9",
    "SELECT run_id, event_id FROM rtm WHERE metric_name IS NOT NULL AND deferred_requests IS NOT NULL",
)
def wide_metric_guard(spark, sf):
    return R.wide_column_values(V.runtime(spark, sf), "deferred_requests").select("run_id", "event_id")


@query(
    "span_expansion", "S15",
    "SELECT run_id, trace_id, span_id, parent_span_id, span_name, duration FROM spans", "duration",
)
def span_expansion(spark, sf):
    return V.spans(spark, sf).select("run_id", "trace_id", "span_id", "parent_span_id", "span_name", "duration")


@query(
    "trace_request_join", "J1 P9",
    """SELECT r.request_id, r.event_id, r.status, t.gateway_span_duration, t.dependency_span_duration, t.llama_span_duration, t.span_count
    FROM req r LEFT JOIN tmap t ON r.run_id = t.run_id AND r.request_id = t.request_id""",
    "gateway_span_duration dependency_span_duration llama_span_duration",
)
def trace_request_join(spark, sf):
    req = V.requests(spark, sf).select(*RUN, "request_id", "event_id", "status")
    return req.join(R.trace_request_map(V.spans(spark, sf)), [*RUN, "request_id"], "left").drop(*RUN)


_TRACE = ("gateway_span_duration_median gateway_span_duration_p95 dependency_span_duration_median dependency_span_duration_p95 "
          "llama_span_duration_median llama_span_duration_p95 dependency_fraction_of_gateway_median llama_fraction_of_gateway_median")


@query("trace_features", "A10", f"SELECT {RUN_SQL}, trace_row_count, {', '.join(_TRACE.split())} FROM tagg", _TRACE)
def trace_features(spark, sf):
    return R.trace_aggregates(R.trace_request_map(V.spans(spark, sf)))


@query(
    "slo_violations", "P6 P7",
    f"""SELECT {RUN_SQL}, ttft_slo_violated, total_latency_slo_violated, decode_duration_slo_violated, slo_violation_count, slo_violation_class,
    (ttft_p95 - {D.SLO_LIMITS['ttft_p95']!r}::DOUBLE) / {D.SLO_LIMITS['ttft_p95']!r}::DOUBLE AS ttft_violation_margin,
    (total_latency_p95 - {D.SLO_LIMITS['total_latency_p95']!r}::DOUBLE) / {D.SLO_LIMITS['total_latency_p95']!r}::DOUBLE AS total_latency_violation_margin,
    (post_first_token_duration_p95 - {D.SLO_LIMITS['post_first_token_duration_p95']!r}::DOUBLE) / {D.SLO_LIMITS['post_first_token_duration_p95']!r}::DOUBLE AS decode_duration_violation_margin
    FROM runs""",
    "ttft_violation_margin total_latency_violation_margin decode_duration_violation_margin",
)
def slo_violations(spark, sf):
    flagged = D.with_slo_flags(R.request_aggregates(V.requests(spark, sf)))
    return flagged.select(*RUN, *D.SLO_FLAGS.values(), "slo_violation_count", "slo_violation_class", *D.SLO_MARGINS.values())
