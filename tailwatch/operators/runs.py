"""Request-level telemetry to run-level metrics, traces and condition summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import null_nan, safe_ratio, stable_round, unpivot  # noqa: F401
from ..functions.student import t_quantile
from .derive import SLO_LIMITS, success_latencies, with_slo_flags
from .design import CONTROLS, LOAD_CONDITIONS
from .grouped import grouped_stats

RUN = ["campaign_id", "condition_id", "repetition", "run_id"]

SUMMARY_METRICS = [
    "ttft_p95", "total_latency_p95", "post_first_token_duration_p95", "ttft_median", "total_latency_median",
    "post_first_token_duration_median", "scheduler_slip_p95", "successful_requests_per_second", "completion_fraction",
    "server_prompt_tokens_median", "server_prompt_tokens_p95", "server_output_tokens_median", "server_output_tokens_p95",
    "dependency_duration_median", "dependency_duration_p95", "requests_processing_max", "requests_processing_median",
    "requests_deferred_max", "requests_deferred_median", "host_cpu_median", "host_cpu_p95", "server_cpu_median",
    "server_cpu_p95", "server_rss_median", "server_rss_max",
]
COUNTED_METRICS = list(SLO_LIMITS)
QUEUE_METRICS = ["requests_deferred_max", "requests_deferred_median", "requests_processing_max", "requests_processing_median"]

# Direct-evidence metrics listed per condition, beyond the queue metrics.
DIRECT_EVIDENCE = {
    "INPUT_MEDIUM": ["server_prompt_tokens_median", "server_prompt_tokens_p95"],
    "OUTPUT_MEDIUM": ["server_output_tokens_median", "server_output_tokens_p95"],
    "LOAD_MEDIUM": [],
    "DOWNSTREAM_MEDIUM": ["dependency_duration_median", "dependency_duration_p95"],
    "INPUT_LOAD": ["server_prompt_tokens_median"],
    "INPUT_DOWNSTREAM": ["server_prompt_tokens_median", "dependency_duration_median"],
    "OUTPUT_LOAD": ["server_output_tokens_median"],
    "OUTPUT_DOWNSTREAM": ["server_output_tokens_median", "dependency_duration_median"],
    "LOAD_DOWNSTREAM": ["dependency_duration_median"],
}


def _median_p95(column: str, stem: str) -> dict[str, dict[str, float]]:
    return {column: {f"{stem}_median": 0.5, f"{stem}_p95": 0.95}}


def request_aggregates(requests: DataFrame, keys: list[str] = RUN, hot_rows: int | None = None) -> DataFrame:
    """Latency percentiles, throughput and status counts per run: one shuffle on the run key."""
    df = success_latencies(requests)
    quantiles = {
        **_median_p95("ttft", "ttft"),
        **_median_p95("total_latency", "total_latency"),
        **_median_p95("post_first_token_duration", "post_first_token_duration"),
        "scheduler_slip": {"scheduler_slip_p95": 0.95},
        **_median_p95("ok_server_prompt_tokens", "server_prompt_tokens"),
        **_median_p95("ok_server_output_tokens", "server_output_tokens"),
        **_median_p95("ok_dependency_duration", "dependency_duration"),
    }
    count_status = lambda s: F.count_if(F.col("status") == s)
    aggs = [
        count_status("success").alias("successful_requests"), count_status("failed").alias("failed_requests"),
        count_status("admission_failed").alias("admission_failed"), F.count(F.lit(1)).alias("measured_request_count"),
        F.min("actual_arrival").alias("_first"), F.max("success_completion").alias("_last"),
    ]
    out = grouped_stats(df, keys, aggs, quantiles, hot_rows)
    span = F.col("_last") - F.col("_first")
    return out.withColumns({
        "successful_requests_per_second": F.when(span > 0, F.col("successful_requests") / span),
        "completion_fraction": safe_ratio(F.col("successful_requests").cast("double"), F.col("measured_request_count").cast("double")),
    }).drop("_first", "_last")


def system_aggregates(system: DataFrame, keys: list[str] = RUN, hot_rows: int | None = None) -> DataFrame:
    return grouped_stats(
        system, keys, [F.max("server_process_rss_bytes").alias("server_rss_max")],
        {
            **_median_p95("host_cpu_percent", "host_cpu"),
            **_median_p95("server_process_cpu_percent", "server_cpu"),
            "server_process_rss_bytes": {"server_rss_median": 0.5},
        },
        hot_rows,
    )


def long_metric(name: str) -> "F.Column":
    return F.when(F.col("metric_name") == name, F.col("metric_value"))


def queue_aggregates(
    metrics: DataFrame, keys: list[str] = RUN, hot_rows: int | None = None,
    deferred: str = "requests_deferred", processing: str = "requests_processing",
) -> DataFrame:
    """Queue evidence read from the long form; the wide columns are empty in recorded telemetry."""
    df = metrics.withColumns({"_def": long_metric(deferred), "_act": long_metric(processing)})
    out = grouped_stats(
        df, keys,
        [F.max("_def").alias("requests_deferred_max"), F.max("_act").alias("requests_processing_max"),
         (F.count("_def") + F.count("_act")).alias("_n")],
        {"_def": {"requests_deferred_median": 0.5}, "_act": {"requests_processing_median": 0.5}}, hot_rows,
    )
    reason = F.when(F.col("_n") == 0, "long-form queue metrics absent from runtime metrics")
    return out.withColumn("runtime_queue_metrics_unavailable_reason", reason).drop("_n")


def wide_column_values(metrics: DataFrame, column: str) -> DataFrame:
    """The read that once returned nothing: wide queue columns of long-form rows. Kept as a guard."""
    return metrics.where(F.col("metric_name").isNotNull() & F.col(column).isNotNull())


def trace_request_map(spans: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """One row per traced request with the duration of each span kind; the latest span wins.

    Shuffles on (run, request), which spreads a hot run over all tasks.
    """
    tagged = spans.withColumn("request_id", F.get_json_object("attributes", "$.request_id")).where(
        F.col("request_id").isNotNull() & F.col("duration").isNotNull()
    )
    # Two doubles as the buffer keep this a hash aggregate; a struct ordering would force sorting.
    kind = lambda name, out: F.max_by(
        F.when(F.col("span_name") == name, F.col("duration")), F.when(F.col("span_name") == name, F.col("start_time"))
    ).alias(out)
    return tagged.groupBy(*keys, "request_id").agg(
        kind("gateway request", "gateway_span_duration"), kind("dependency call", "dependency_span_duration"),
        kind("llama call", "llama_span_duration"), F.count(F.lit(1)).alias("span_count"),
    )


def trace_aggregates(trace_map: DataFrame, keys: list[str] = RUN, hot_rows: int | None = None, spans: DataFrame | None = None) -> DataFrame:
    """``spans`` are those of the map: a run has at least as many of them as traced requests."""
    df = trace_map.withColumns({
        "_df": safe_ratio(F.col("dependency_span_duration"), F.col("gateway_span_duration")),
        "_lf": safe_ratio(F.col("llama_span_duration"), F.col("gateway_span_duration")),
    })
    return grouped_stats(
        df, keys, [F.sum("span_count").alias("trace_row_count")],
        {
            **_median_p95("gateway_span_duration", "gateway_span_duration"),
            **_median_p95("dependency_span_duration", "dependency_span_duration"),
            **_median_p95("llama_span_duration", "llama_span_duration"),
            "_df": {"dependency_fraction_of_gateway_median": 0.5},
            "_lf": {"llama_fraction_of_gateway_median": 0.5},
        },
        hot_rows, spans,
    )


def run_metrics(
    requests: DataFrame, system: DataFrame, metrics: DataFrame, spans: DataFrame, keys: list[str] = RUN,
    hot_rows: int | None = None,
) -> DataFrame:
    """The wide run table. Every input is reduced to one row per run before the joins, and all are
    partitioned by the same key."""
    out = request_aggregates(requests, keys, hot_rows)
    for part in (
        system_aggregates(system, keys, hot_rows), queue_aggregates(metrics, keys, hot_rows=hot_rows),
        trace_aggregates(trace_request_map(spans, keys), keys, hot_rows, spans),
    ):
        out = out.join(part, keys, "left")
    reason = F.when(F.col("server_cpu_median").isNull() & F.col("server_rss_median").isNull(), "server process telemetry not supplied")
    return with_slo_flags(out.withColumn("server_process_metrics_unavailable_reason", reason))


def compact_run_metrics(requests: DataFrame, keys: list[str] = RUN, hot_rows: int | None = None) -> DataFrame:
    """The ten columns used for calibration."""
    return request_aggregates(requests, keys, hot_rows).select(
        *keys, F.col("measured_request_count").alias("planned_requests"), "successful_requests", "failed_requests",
        "admission_failed", "ttft_p95", "total_latency_p95", "post_first_token_duration_p95", "scheduler_slip_p95",
        "successful_requests_per_second", "completion_fraction",
    )


def pilot_run_summary(requests: DataFrame, system: DataFrame, metrics: DataFrame, targets: DataFrame,
                      keys: list[str] = RUN, hot_rows: int | None = None) -> DataFrame:
    """The widest pilot summary: run metrics plus token realisation, decode rate and arrival rate.

    ``targets`` holds one row per run with ``target_output_tokens``.
    """
    df = success_latencies(requests).withColumn("_per_token", F.when(
        F.col("ok_server_output_tokens") > 0, F.col("post_first_token_duration") / F.col("ok_server_output_tokens")))
    tokens = grouped_stats(
        df, keys,
        [F.count("actual_arrival").alias("_n"), F.min("actual_arrival").alias("_a0"), F.max("actual_arrival").alias("_a1")],
        # The target is one number per run, so the fraction's percentiles are the token percentiles over it.
        {"ok_server_output_tokens": {"_tok05": 0.05, "_tok50": 0.5}, "_per_token": {"seconds_per_output_token_median": 0.5},
         "scheduler_slip": {"scheduler_slip_median": 0.5}},
        hot_rows,
    ).join(targets.select(*keys, "target_output_tokens"), keys, "left")
    goal = F.col("target_output_tokens").cast("double")
    tokens = tokens.withColumns({
        "token_realization_floor": safe_ratio(F.col("_tok05"), goal),
        "token_realization_median": safe_ratio(F.col("_tok50"), goal),
        "actual_arrival_rate": F.when((F.col("_n") > 1) & (F.col("_a1") > F.col("_a0")), (F.col("_n") - 1) / (F.col("_a1") - F.col("_a0"))),
    }).drop("_n", "_a0", "_a1", "_tok05", "_tok50", "target_output_tokens")
    base = request_aggregates(requests, keys, hot_rows)
    return base.join(tokens, keys).join(system_aggregates(system, keys, hot_rows), keys, "left").join(
        queue_aggregates(metrics, keys, hot_rows=hot_rows), keys, "left")


def mean_interval(n, mean, sd, collapse: bool = False) -> tuple:
    """Student-t bounds. Below two values: null, or the mean itself when ``collapse`` is set."""
    half = t_quantile(0.975, n - 1) * sd / F.sqrt(n)
    if collapse:
        half = F.when((n < 2) | (sd <= 0), F.lit(0.0)).otherwise(half)
    else:
        half = F.when(n >= 2, half)
    return mean - half, mean + half


def summarize_long(long: DataFrame, keys: list[str], value: str = "value", collapse: bool = False,
                   medians: bool = True, hot_rows: int | None = None) -> DataFrame:
    """n, mean, sd, interval, median, min, max of a long table."""
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
            F.min(value).alias("min"), F.max(value).alias("max")]
    out = grouped_stats(long, keys, aggs, {value: {"median": 0.5}} if medians else None, hot_rows)
    low, high = mean_interval(F.col("n"), F.col("mean"), F.col("sd"), collapse)
    return out.withColumns({"ci_low": low, "ci_high": high})


def condition_summary(runs: DataFrame, metrics: list[str] = SUMMARY_METRICS, hot_rows: int | None = None) -> DataFrame:
    keys = ["campaign_id", "condition_id"]
    return summarize_long(unpivot(runs, keys, metrics, "metric"), [*keys, "metric"], hot_rows=hot_rows)


def wilson_interval(k, n) -> tuple:
    """Wilson score bounds at 95 %, clipped to [0, 1]; null for no trials."""
    z2 = 1.959963984540054**2
    p = safe_ratio(k.cast("double"), n.cast("double"))
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.lit(1.959963984540054) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)




def violation_frequency(runs: DataFrame, keys: list[str] = ["campaign_id", "condition_id"]) -> DataFrame:
    """Six violation counts per condition, each with proportion and Wilson bounds, in long form."""
    klass = lambda name: F.count_if(F.col("slo_violation_class") == name)
    counts = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("ttft_slo_violated").alias("ttft_violations"),
        F.sum("total_latency_slo_violated").alias("total_latency_violations"),
        F.sum("decode_duration_slo_violated").alias("decode_duration_violations"),
        klass("NO_COUNTED_SLO_VIOLATION").alias("no_slo_runs"),
        klass("SINGLE_SLO_VIOLATION").alias("single_slo_runs"),
        klass("COMPOUND_SLO_VIOLATION").alias("compound_slo_runs"),
    )
    names = [c for c in counts.columns if c not in (*keys, "n")]
    long = counts.unpivot([*keys, "n"], names, "count_name", "count")
    low, high = wilson_interval(F.col("count"), F.col("n"))
    return long.withColumns({"proportion": F.col("count") / F.col("n"), "wilson_low": low, "wilson_high": high})


def _evidence_spec(runs: DataFrame) -> DataFrame:
    rows = [(c, m) for c, extra in DIRECT_EVIDENCE.items() for m in [*extra, *QUEUE_METRICS]]
    return runs.sparkSession.createDataFrame(rows, "condition_id string, metric string")


def direct_evidence(runs: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Value of every listed evidence metric per run, next to the median, range and queue flag of
    its condition. Values stay rows instead of one list per condition."""
    keys = ["campaign_id", "condition_id", "metric"]
    metrics = sorted({m for ms in DIRECT_EVIDENCE.values() for m in ms} | set(QUEUE_METRICS))
    long = unpivot(runs, ["campaign_id", "condition_id", "repetition"], metrics, "metric").where("value is not null")
    long = long.join(F.broadcast(_evidence_spec(runs)), ["condition_id", "metric"])
    stats = grouped_stats(long, keys, [F.min("value").alias("min"), F.max("value").alias("max")], {"value": {"median": 0.5}}, hot_rows)
    secondary = (F.col("metric") == "requests_deferred_max") & ~F.col("condition_id").isin(*LOAD_CONDITIONS) & (F.col("max") > 0)
    return long.join(stats.withColumn("queue_secondary_signature", secondary.cast("int")), keys)


def queue_signatures(runs: DataFrame, hot_rows: int | None = None) -> DataFrame:
    keys = ["campaign_id", "condition_id"]
    out = grouped_stats(
        runs, keys,
        [F.max("requests_deferred_max").alias("requests_deferred_max_max"),
         F.max("requests_processing_max").alias("requests_processing_max_max"), F.count(F.lit(1)).alias("runs")],
        {"requests_deferred_max": {"requests_deferred_max_median": 0.5},
         "requests_processing_max": {"requests_processing_max_median": 0.5}}, hot_rows,
    )
    intended = F.col("condition_id").isin(*LOAD_CONDITIONS)
    seen = F.coalesce(F.col("requests_deferred_max_max") > 0, F.lit(False))
    return out.withColumns({
        "queueing_intended": intended.cast("int"), "secondary_observed_queue_signature": (seen & ~intended).cast("int"),
    })


def descriptive_stability(long: DataFrame, keys: list[str], value: str = "value", hot_rows: int | None = None) -> DataFrame:
    """Min, median, max, interquartile range, and population SD over mean."""
    out = grouped_stats(
        long, keys, [F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")],
        {value: {"median": 0.5, "_q1": 0.25, "_q3": 0.75}}, hot_rows,
    )
    return out.withColumns({"iqr": F.col("_q3") - F.col("_q1"), "cv": safe_ratio(F.col("_s"), F.col("_m"))}).drop("_m", "_s", "_q1", "_q3")


def control_crossings(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Control runs over each limit and over any limit."""
    over = {m: F.coalesce(F.col(m) > F.lit(x), F.lit(False)) for m, x in SLO_LIMITS.items()}
    anyone = over["ttft_p95"] | over["total_latency_p95"] | over["post_first_token_duration_p95"]
    return runs.where(F.col("condition_id").isin(*CONTROLS)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"{m}_crossings") for m, c in over.items()],
        F.count_if(anyone).alias("any_counted_slo_crossings"),
    )


def class_counts(runs: DataFrame, keys: list[str], column: str, classes: list[str]) -> DataFrame:
    """Count per class with the classes that never occur kept at zero: one conditional count each."""
    wide = runs.groupBy(*keys).agg(*[F.count_if(F.col(column) == c).alias(c) for c in classes])
    return wide.unpivot(keys, classes, column, "count")
