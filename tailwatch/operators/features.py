"""Feature vocabulary of the diagnosis methods: tiers, channels, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .derive import SLO_FLAGS, SLO_MARGINS
from .design import CAUSES

# Feature tiers.
F0 = [*SLO_FLAGS.values(), *SLO_MARGINS.values()]
F1 = [
    "ttft_p95", "total_latency_p95", "post_first_token_duration_p95", "ttft_median", "total_latency_median",
    "post_first_token_duration_median", "scheduler_slip_p95", "successful_requests_per_second",
]
TRACE = [
    "gateway_span_duration_median", "gateway_span_duration_p95", "dependency_span_duration_median",
    "dependency_span_duration_p95", "llama_span_duration_median", "llama_span_duration_p95",
    "dependency_fraction_of_gateway_median", "llama_fraction_of_gateway_median",
]
F2 = [*F1, "host_cpu_median", "host_cpu_p95", "dependency_duration_median", "dependency_duration_p95", *TRACE]
DIRECT = ["server_prompt_tokens_median", "server_output_tokens_median"]
F3 = [*F2, *DIRECT]
WINDOW_STATS = ["early_median", "late_median", "late_minus_early", "normalized_slope"]
TEMPORAL_METRICS = ["ttft", "total_latency", "post_first_token_duration", "prefill_proxy", "dependency_duration", "scheduler_slip"]
TRACE_METRICS = ["gateway_span_duration", "llama_span_duration", "dependency_span_duration"]
TEMPORAL = [f"{m}_{s}" for m in TEMPORAL_METRICS for s in WINDOW_STATS] + [f"{m}_{s}" for m in TRACE_METRICS for s in WINDOW_STATS[2:]]
F2T = [*F2, *TEMPORAL]
PREFILL = ["prefill_proxy_median", "prefill_proxy_p95"]
TIERS = {"F0": F0, "F1": F1, "F2": F2, "F2T": F2T, "F3": F3}
METHOD_TIER = {"M2/F2": "F2", "M2/F2T": "F2T", "D4-FULL": "F2T", "D4-FULL-F3": "F3"}
FORBIDDEN = ["condition_id", "active_mechanisms", "mechanism_levels", "compound_degree", "run_id"]

_pair = lambda stem: [f"{stem}_median", f"{stem}_p95"]
_trend = lambda stem: [f"{stem}_late_minus_early", f"{stem}_normalized_slope"]

# Evidence channels. S is shared by the causes; M and T belong to one cause each.
SIGNATURE = {
    "TTFT_CHANNEL": _pair("ttft"), "TOTAL_LATENCY_CHANNEL": _pair("total_latency"), "DECODE_CHANNEL": _pair("post_first_token_duration"),
    "THROUGHPUT_CHANNEL": ["successful_requests_per_second"], "HOST_CPU_CHANNEL": _pair("host_cpu"),
    "GATEWAY_SPAN_CHANNEL": _pair("gateway_span_duration"), "LLAMA_SPAN_CHANNEL": _pair("llama_span_duration"),
}
MECHANISM = {
    "INPUT": {"PREFILL_PROXY_CHANNEL": _pair("prefill_proxy"), "TTFT_CHANNEL": _pair("ttft")},
    "OUTPUT": {"DECODE_DURATION_CHANNEL": _pair("post_first_token_duration"), "LLAMA_DURATION_CHANNEL": _pair("llama_span_duration")},
    "LOAD": {"TTFT_EVOLUTION_CHANNEL": _trend("ttft"), "TOTAL_EVOLUTION_CHANNEL": _trend("total_latency"),
             "SCHEDULER_EVOLUTION_CHANNEL": _trend("scheduler_slip"), "THROUGHPUT_CHANNEL": ["successful_requests_per_second"]},
    "DOWNSTREAM": {"DEPENDENCY_DURATION_CHANNEL": _pair("dependency_duration") + _pair("dependency_span_duration"),
                   "DEPENDENCY_FRACTION_CHANNEL": ["dependency_fraction_of_gateway_median"]},
}
EVOLUTION = {
    "INPUT": {"PREFILL_EVOLUTION": _trend("prefill_proxy"), "TTFT_EVOLUTION": _trend("ttft")},
    "OUTPUT": {"DECODE_EVOLUTION": _trend("post_first_token_duration"), "LLAMA_EVOLUTION": _trend("llama_span_duration")},
    "LOAD": {"TTFT_EVOLUTION": _trend("ttft"), "TOTAL_LATENCY_EVOLUTION": _trend("total_latency"), "SCHEDULER_EVOLUTION": _trend("scheduler_slip")},
    "DOWNSTREAM": {"DEPENDENCY_REQUEST_EVOLUTION": _trend("dependency_duration"), "DEPENDENCY_TRACE_EVOLUTION": _trend("dependency_span_duration")},
}
DIRECT_CHANNEL = {"INPUT": ("INPUT_DIRECT_EVIDENCE_CHANNEL", DIRECT[0]), "OUTPUT": ("OUTPUT_DIRECT_EVIDENCE_CHANNEL", DIRECT[1])}

# Telemetry channels that can be lost.
LOST_CHANNELS = {
    "C1_HOST_CPU": _pair("host_cpu"),
    "C2_DEPENDENCY": _pair("dependency_duration") + _pair("dependency_span_duration") + ["dependency_fraction_of_gateway_median"],
    "C3_TRACE_SPAN": [*TRACE, *[t for m in TRACE_METRICS for t in _trend(m)]],
    "C4_TEMPORAL_EVOLUTION": TEMPORAL,
    "C5_THROUGHPUT_SCHEDULER": ["successful_requests_per_second", "scheduler_slip_p95", *_trend("scheduler_slip")],
    "C6_LATENCY_P95": ["ttft_p95", "total_latency_p95", "post_first_token_duration_p95"],
    "C7_MEDIAN_LATENCY": ["ttft_median", "total_latency_median", "post_first_token_duration_median"],
    "C8_MECHANISM_ANCHOR": sorted({f for c in CAUSES for fs in MECHANISM[c].values() for f in fs}),
    "C9_PROMPT_OUTPUT_DIRECT": DIRECT,
}

# Features whose name marks a quantity that cannot be negative.
NONNEGATIVE_TOKENS = ["duration", "latency", "ttft", "slip", "cpu", "fraction", "second", "token", "span"]


def evidence_rows() -> list[tuple[int, str, str, str, str]]:
    """(f3, cause, group, channel, feature) for the plain and the direct-evidence variant."""
    rows = []
    for f3 in (0, 1):
        for cause in CAUSES:
            groups = {"S": SIGNATURE, "M": dict(MECHANISM[cause]), "T": EVOLUTION[cause]}
            if f3 and cause in DIRECT_CHANNEL:
                channel, feature = DIRECT_CHANNEL[cause]
                groups["M"] = {**groups["M"], channel: [feature]}
            rows += [(f3, cause, g, ch, f) for g, chans in groups.items() for ch, fs in chans.items() for f in fs]
    return rows


def evidence_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(evidence_rows(), "f3 int, cause string, grp string, channel string, feature string")


def plain_group_rows() -> list[tuple[str, str, str]]:
    """(cause, group, feature) of the earlier ungrouped flavour; a feature keeps its last group."""
    general = [*F1[:6], "successful_requests_per_second", "host_cpu_median", "host_cpu_p95", "gateway_span_duration_median", "llama_span_duration_median"]
    out = []
    for cause in CAUSES:
        place = {f: "S" for f in general}
        place.update({f: "M" for fs in MECHANISM[cause].values() for f in fs})
        place.update({f: "T" for fs in EVOLUTION[cause].values() for f in fs})
        out += [(cause, g, f) for f, g in place.items()]
    return out


def plain_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(plain_group_rows(), "cause string, grp string, feature string")


def tier_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, f) for t, fs in TIERS.items() for f in fs], "tier string, feature string")


def leakage_audit(registry: DataFrame, forbidden: list[str] = FORBIDDEN) -> DataFrame:
    """Forbidden columns found in each tier."""
    bad = F.count_if(F.col("feature").isin(*forbidden))
    return registry.groupBy("tier").agg(bad.alias("issues"), F.count(F.lit(1)).alias("features")).withColumn("passed", (F.col("issues") == 0).cast("int"))


def channel_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, f) for c, fs in LOST_CHANNELS.items() for f in fs], "lost string, feature string")
