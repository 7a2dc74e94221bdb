"""Data-quality rules. Every rule yields issue rows ``(run keys, subject, code)``.

Row rules are one narrow pass: an array of conditional codes, exploded. Rules that need company
(duplicates, trees, bounds) reduce to one row per id or run before any join, and the joins carry the
request in their key wherever requests are involved.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import GATEWAY_FIELDS
from .ordered import with_lag

RUN = ["campaign_id", "condition_id", "repetition", "run_id"]
TIME_SLACK = 1e-9
SPAN_NAMES = ["gateway request", "dependency call", "llama call"]

# Legal state changes of a run.
TRANSITIONS = {
    "PLANNED": ["PREPARING", "FAILED"], "PREPARING": ["WARMUP", "FAILED"], "WARMUP": ["BASELINE", "FAILED"],
    "BASELINE": ["INJECTING", "RECOVERY", "FAILED"], "INJECTING": ["RECOVERY", "FAILED"], "RECOVERY": ["COMPLETE", "FAILED"],
    "COMPLETE": [], "FAILED": [],
}


def _codes(rules: Mapping[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules.items()]))


def findings(rows: DataFrame, keys: Sequence[str], subject: Column, rules: Mapping[str, Column]) -> DataFrame:
    """One issue row per rule that holds."""
    return rows.select(*keys, subject.alias("subject"), F.explode(_codes(rules)).alias("code"))


def held(rules: Mapping[str, Column]) -> Column:
    """How many rules hold: the rows that ``findings`` would make of one."""
    return F.size(_codes(rules))


def request_issues(requests: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Status, timestamp order, error metadata, gateway timing, slip and admission rules."""
    return findings(requests, keys, F.col("request_id"), request_rules())


def request_rules() -> dict[str, Column]:
    c = F.col
    failed, known = c("status") == "failed", c("status").isin("success", "failed", "admission_failed")
    arrived, sent = c("actual_arrival").isNotNull(), c("dispatch_time").isNotNull()
    timed = arrived & sent
    gate = [c(f) for f in GATEWAY_FIELDS if f not in ("llama_first_token_time", "dependency_duration")]
    present = sum((g.isNotNull().cast("int") for g in gate[1:]), gate[0].isNotNull().cast("int"))
    full = present == len(gate)
    ordered = F.lit(True)
    for a, b in zip(gate, gate[1:]):
        ordered = ordered & (a <= b)
    model = c("llama_first_token_time")
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    return {
        "unknown_status": ~known,
        "arrival_missing": ~arrived & ~failed,
        "dispatch_missing": arrived & ~sent & ~failed,
        "arrival_after_dispatch": timed & (c("actual_arrival") > c("dispatch_time")),
        "dispatch_after_first_token": timed & (c("dispatch_time") > c("first_token_time")),
        "first_token_after_completion": timed & (c("first_token_time") > c("completion_time")),
        "dispatch_after_completion": timed & (c("dispatch_time") > c("completion_time")),
        "completion_missing": timed & c("completion_time").isNull() & ~failed,
        "success_without_first_token": timed & (c("status") == "success") & c("first_token_time").isNull(),
        "success_without_completion": timed & (c("status") == "success") & c("completion_time").isNull(),
        "failed_without_error": timed & failed & blank(c("error_type")) & blank(c("error_message")),
        "partial_gateway_timing": timed & (present > 0) & ~full,
        "gateway_timing_out_of_order": timed & full & ~ordered,
        "model_first_token_out_of_order": timed & full & ~((c("llama_dispatch_time") <= model) & (model <= c("gateway_completion_time"))),
        "dependency_duration_mismatch": timed & full & (F.abs(c("dependency_duration") - (c("dependency_end_time") - c("dependency_start_time"))) > 0.010),
        "negative_scheduler_slip": (c("status") != "admission_failed") & (c("actual_arrival") + 0.005 < c("scheduled_arrival")),
        "scheduler_slip_mismatch": (c("status") != "admission_failed") & (F.abs(c("scheduler_slip") - (c("actual_arrival") - c("scheduled_arrival"))) > 1e-6),
        "outstanding_limit_exceeded": c("status") == "admission_failed",
    }


def identity_issues(requests: DataFrame, configs: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Runtime or model other than the configured one. ``configs`` has one row per run."""
    conf = configs.select(*keys, F.col("runtime_id").alias("_r"), F.col("model_id").alias("_m"))
    return findings(requests.join(conf, list(keys)), keys, F.col("request_id"), {"unknown_runtime_or_model": other_identity(F.col("_r"), F.col("_m"))})


def other_identity(runtime: Column, model: Column) -> Column:
    return ~(F.col("runtime_id").eqNullSafe(runtime) & F.col("model_id").eqNullSafe(model))


def gateway_gaps(requests: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Names of the missing gateway columns of successful requests."""
    out = requests.where("status = 'success'").select(*keys, F.col("request_id").alias("subject"), F.array_join(missing_gateway_fields(), ",").alias("missing"))
    return out.where("missing <> ''").withColumn("code", F.lit("missing_gateway_timing"))


def missing_gateway_fields() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in GATEWAY_FIELDS]))


def duplicates(rows: DataFrame, keys: Sequence[str], column: str, code: str) -> DataFrame:
    """Ids occurring more than once, with how often beyond the first. Counts combine on the map side."""
    return rows.groupBy(*keys, F.col(column).alias("subject")).agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0").withColumn("code", F.lit(code))


def unplanned(requests: DataFrame, plan: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    out = requests.join(plan.select(*keys, "request_id"), [*keys, "request_id"], "left_anti")
    return out.select(*keys, F.col("request_id").alias("subject"), F.lit("unknown_request").alias("code"))


def accounting(requests: DataFrame, plan: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Planned and recorded requests per run; a run known to one side only still shows."""
    a = plan.groupBy(*keys).agg(F.count(F.lit(1)).alias("planned"))
    b = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("accounted"))
    out = a.join(b, list(keys), "full_outer").fillna(0, ["planned", "accounted"])
    return out.withColumn("accounting_ok", (F.col("planned") == F.col("accounted")).cast("int"))


def span_format_issues(spans: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    return findings(spans, keys, F.col("span_id"), span_format_rules())


def span_format_rules() -> dict[str, Column]:
    c = F.col
    return {
        "malformed_trace_id": ~F.coalesce(c("trace_id").rlike("^[0-9a-f]{32}$"), F.lit(False)),
        "malformed_span_id": ~F.coalesce(c("span_id").rlike("^[0-9a-f]{16}$"), F.lit(False)),
        "malformed_parent_id": c("parent_span_id").isNotNull() & ~c("parent_span_id").rlike("^[0-9a-f]{16}$"),
        "malformed_attributes": F.get_json_object("attributes", "$").isNull(),
    }


def foreign_spans(spans: DataFrame, plan: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Spans whose request is not planned. Rows without a request id keep a random-free null key and stay."""
    tagged = spans.withColumn("request_id", F.get_json_object("attributes", "$.request_id"))
    out = tagged.join(plan.select(*keys, "request_id"), [*keys, "request_id"], "left_anti")
    return out.select(*keys, F.col("span_id").alias("subject"), F.lit("foreign_trace_request").alias("code"))


def span_trees(requests: DataFrame, spans: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Completeness of each successful request's trace: three names, one root, children under it.

    The tree test is conditional counts per request, so no span joins another span.
    """
    tagged = spans.withColumn("request_id", F.get_json_object("attributes", "$.request_id"))
    per = tagged.groupBy(*keys, "request_id").agg(*_tree_columns(F.lit(1)))
    out = requests.where("status = 'success'").select(*keys, "request_id").join(per, [*keys, "request_id"], "left")
    return findings(out, keys, F.col("request_id"), _tree_rules())


def _tree_columns(row: Column) -> list[Column]:
    """Aggregates over a request's spans; ``row`` is not null in rows that are spans."""
    is_ = lambda n: F.col("span_name") == n
    root = is_(SPAN_NAMES[0])
    return [
        F.count(row).alias("spans"), *[F.count_if(is_(n)).alias(f"_n{i}") for i, n in enumerate(SPAN_NAMES)],
        F.count_if(root & F.col("parent_span_id").isNull()).alias("_roots"), F.max(F.when(root, F.col("span_id"))).alias("_root"),
        F.max(F.when(root, F.col("trace_id"))).alias("_trace"),
        *[F.max(F.when(is_(n), F.col(k))).alias(f"_{k}{i}") for i, n in enumerate(SPAN_NAMES[1:], 1) for k in ("parent_span_id", "trace_id")],
    ]


def _tree_rules() -> dict[str, Column]:
    three = (F.col("spans") == 3) & (F.col("_n0") == 1) & (F.col("_n1") == 1) & (F.col("_n2") == 1)
    whole = F.coalesce(three & (F.col("_roots") == 1), F.lit(False))
    child = lambda i: ~(F.col(f"_trace_id{i}").eqNullSafe(F.col("_trace")) & F.col(f"_parent_span_id{i}").eqNullSafe(F.col("_root")))
    return {"missing_request_span": ~whole, "orphan_dependency_span": whole & child(1), "orphan_model_span": whole & child(2)}


def ledger_counts(requests: DataFrame, spans: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Findings of all rules on a run's requests, plan and spans, counted by run from one row a request.

    ``requests``: keys, request_id, status, copies (rows of the plan); ``spans``: span columns and copies (further rows of the
    same span). Columns dq_duplicates, dq_unplanned, dq_accounting, dq_spans, dq_foreign_spans, dq_span_duplicates and
    dq_span_trees have the numbers of rows of the rules of that name. Both frames are best dealt by the keys.
    """
    keys = list(keys)
    c = F.col
    tagged = spans.withColumns({"request_id": F.get_json_object("attributes", "$.request_id"), "_format": held(span_format_rules())})
    one = requests.select(*keys, "request_id", c("copies").alias("_plan"), F.lit(1).alias("_row"), (c("status") == "success").cast("int").alias("_success"))
    both = one.unionByName(tagged.select(*keys, "request_id", "span_name", "trace_id", "span_id", "parent_span_id", "_format", c("copies").alias("_again")), allowMissingColumns=True)
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    named = [F.sum(F.when(c("span_name") == n, 1 + c("_again"))).alias(f"_all{i}") for i, n in enumerate(SPAN_NAMES)]
    per = both.groupBy(*keys, "request_id").agg(total("_plan"), total("_row"), total("_success"), total("_format"), *_tree_columns(c("_again")), *named)
    foreign = (c("_plan") == 0) | c("request_id").isNull()  # null meets no plan
    twice = sum((F.coalesce(c(f"_all{i}") > 1, F.lit(False)).cast("int") for i in range(1, len(SPAN_NAMES))), F.coalesce(c("_all0") > 1, F.lit(False)).cast("int"))
    counts = {
        "dq_duplicates": (c("_plan") > 1).cast("int"), "dq_unplanned": F.when(foreign, c("_row")).otherwise(0), "dq_spans": c("_format"),
        "dq_foreign_spans": F.when(foreign, c("spans")).otherwise(0), "dq_span_duplicates": F.when(c("request_id").isNotNull(), twice).otherwise(0),
        "dq_span_trees": c("_success") * F.when(c("request_id").isNull(), 1).otherwise(held(_tree_rules())),
    }
    rows = per.select(*keys, "_plan", "_row", *[n.alias(name) for name, n in counts.items()])
    return rows.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in counts], (F.sum("_plan") != F.sum("_row")).cast("long").alias("dq_accounting"))


def mechanism_match(configured: DataFrame, recorded: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Configured against recorded mechanisms: either side missing, or fields that differ."""
    fields = ["mechanism_type", "target", "intensity", "scheduled_onset", "scheduled_stop"]
    a = configured.select(*keys, "mechanism_id", *[F.col(f).alias(f"_c_{f}") for f in fields], F.lit(1).alias("_c"))
    b = recorded.select(*keys, "mechanism_id", *fields, F.lit(1).alias("_g"))
    both = a.join(b, [*keys, "mechanism_id"], "full_outer")
    here = F.col("_c").isNotNull() & F.col("_g").isNotNull()
    differ = lambda f: here & ~F.col(f).eqNullSafe(F.col(f"_c_{f}"))
    return findings(both, keys, F.col("mechanism_id"), {
        "mechanism_not_recorded": F.col("_g").isNull(), "unknown_recorded_mechanism": F.col("_c").isNull(),
        "mechanism_type_mismatch": differ("mechanism_type"), "mechanism_target_mismatch": differ("target"),
        "mechanism_intensity_mismatch": differ("intensity"), "mechanism_schedule_mismatch": differ("scheduled_onset") | differ("scheduled_stop")})


def mechanism_issues(mechanisms: DataFrame, injecting: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Evidence, activation, verification, order and cleanup rules. ``injecting`` has the first
    INJECTING time of each run."""
    c = F.col
    df = mechanisms.join(injecting, list(keys), "left")
    live = c("verification_state").isin("ACTIVE", "STOPPED")
    rules = {
        "active_without_evidence": live & ~F.coalesce(c("verified"), F.lit(False)),
        "onset_not_activation_time": live & (F.abs(c("actual_onset") - c("activation_time")) > 1e-6),
        "missing_verification_time": live & c("verification_time").isNull(),
        "verification_failed": c("verification_state") == "VERIFICATION_FAILED",
        "activation_before_injecting": c("actual_onset") < c("inject_start"),
        "onset_before_schedule": c("actual_onset") + 1e-12 < c("inject_start") + c("scheduled_onset"),
        "stop_before_onset": c("actual_stop") < c("actual_onset"),
        "not_cleaned_up": ~F.coalesce(c("cleaned_up"), F.lit(False)),
    }
    return findings(df, keys, c("mechanism_id"), rules)


def label_evidence(labelled_runs: DataFrame, mechanisms: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Runs labelled downstream without a verified downstream mechanism."""
    ok = mechanisms.groupBy(*keys).agg(F.bool_or((F.col("mechanism_type") == "downstream_latency") & F.coalesce(F.col("verified"), F.lit(False))).alias("_ok"))
    out = labelled_runs.where(F.col("label_DOWNSTREAM") == 1).join(ok, list(keys), "left").where(~F.coalesce("_ok", F.lit(False)))
    return out.select(*keys, F.col("run_id").alias("subject"), F.lit("downstream_label_without_evidence").alias("code"))


def outside_windows(requests: DataFrame, mechanisms: DataFrame, required: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Successful requests not inside every stopped mechanism window of a run that requires it.

    Lying inside all windows is lying after the latest start and before the earliest stop, so the
    interval join becomes one bounds row per run.
    """
    c = F.col
    out = requests.where("status = 'success'").join(needed_windows(mechanisms, required, keys), list(keys))
    return findings(out, keys, c("request_id"), {"outside_mechanism_window": outside_window()})


def needed_windows(mechanisms: DataFrame, required: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Latest start and earliest stop of each run that requires a window."""
    c = F.col
    stopped = mechanisms.where("verification_state = 'STOPPED'").groupBy(*keys).agg(
        F.max("actual_onset").alias("_start"), F.min("actual_stop").alias("_stop"),
        F.count_if(c("actual_onset").isNull() | c("actual_stop").isNull()).alias("_open"))
    return required.select(*keys).join(stopped, list(keys), "left")


def outside_window() -> Column:
    c = F.col
    covered = (c("_open") == 0) & (c("actual_arrival") + TIME_SLACK >= c("_start")) & (c("completion_time") <= c("_stop") + TIME_SLACK)
    return ~F.coalesce(covered, F.lit(False))


def event_bounds(events: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    return events.groupBy(*keys).agg(F.min("monotonic_time").alias("_first"), F.max("monotonic_time").alias("_last"))


def outside_bounds(samples: DataFrame, bounds: DataFrame, subject: str, code: str, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Samples taken outside the event span of their run."""
    return findings(samples.join(bounds, list(keys)), keys, F.col(subject), {code: out_of_bounds(F.col("timestamp"))})


def out_of_bounds(t: Column) -> Column:
    return (t + TIME_SLACK < F.col("_first")) | (t - TIME_SLACK > F.col("_last"))


def lifecycle_issues(events: DataFrame, keys: Sequence[str] = tuple(RUN), hot_rows: int | None = None) -> DataFrame:
    """Time order over all events, legal state changes, the first state, and one terminal state."""
    timed = with_lag(events, keys, ["event_seq"], {"_before": "monotonic_time"}, hot_rows=hot_rows)
    late = findings(timed, keys, F.col("event_seq").cast("string"), {"event_time_not_monotonic": F.col("monotonic_time") < F.col("_before")})
    states = events.where(F.col("event_type") == "state")
    unknown = findings(states, keys, F.col("state"), {"unknown_lifecycle_state": ~F.col("state").isin(*TRANSITIONS)})
    moves = with_lag(states.where(F.col("state").isin(*TRANSITIONS)), keys, ["event_seq"], {"_from": "state"}, hot_rows=hot_rows)
    legal = [f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in bs]
    step = F.concat_ws(">", "_from", "state")
    illegal = findings(moves, keys, F.when(F.col("_from").isNull(), F.col("state")).otherwise(step), {
        "lifecycle_not_started_at_planned": F.col("_from").isNull() & (F.col("state") != "PLANNED"),
        "illegal_lifecycle_transition": F.col("_from").isNotNull() & ~step.isin(*legal)})
    ends = states.groupBy(*keys).agg(F.count_if(F.col("state").isin("COMPLETE", "FAILED")).alias("_t"))
    terminal = findings(ends, keys, F.col("run_id"), {"terminal_state_count": F.col("_t") != 1})
    return late.unionByName(unknown).unionByName(illegal).unionByName(terminal)


def terminal_issues(events: DataFrame, requests: DataFrame, mechanisms: DataFrame, manifests: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Last state against manifest, recovery, last completion and cleanup: all one row per run first."""
    states = events.where(F.col("event_type") == "state")
    last = states.groupBy(*keys).agg(
        F.max_by("state", "event_seq").alias("_state"), F.max_by("monotonic_time", "event_seq").alias("_at"), F.count_if(F.col("state") == "RECOVERY").alias("_rec"))
    done = requests.groupBy(*keys).agg(F.max("completion_time").alias("_done"))
    dirty = mechanisms.groupBy(*keys).agg(F.bool_or(~F.coalesce(F.col("cleaned_up"), F.lit(False))).alias("_dirty"))
    df = last.join(manifests, list(keys), "left").join(done, list(keys), "left").join(dirty, list(keys), "left")
    complete = F.col("_state") == "COMPLETE"
    return findings(df, keys, F.col("run_id"), {
        "terminal_manifest_mismatch": ~F.col("_state").eqNullSafe(F.col("final_state")), "failed_lifecycle_state": F.col("_state") == "FAILED",
        "complete_before_recovery": complete & (F.col("_rec") == 0), "complete_before_request_completion": complete & (F.col("_at") < F.col("_done")),
        "complete_before_cleanup": complete & F.coalesce(F.col("_dirty"), F.lit(False))})


def phase_issues(events: DataFrame, requests: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Arrivals at or after the first RECOVERY, and timeout events."""
    per = phase_times(events, keys)
    late = requests.join(per.where("_b is not null"), list(keys))
    a = findings(late, keys, F.col("request_id"), {"workload_after_recovery": F.col("actual_arrival") >= F.col("_r")})
    return a.unionByName(findings(per, keys, F.col("run_id"), {"experiment_timeout": F.col("_t") > 0}))


def phase_times(events: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """First BASELINE and RECOVERY and number of timeouts of each run."""
    state = lambda s: F.min(F.when((F.col("event_type") == "state") & (F.col("state") == s), F.col("monotonic_time")))
    return events.groupBy(*keys).agg(state("BASELINE").alias("_b"), state("RECOVERY").alias("_r"), F.count_if(F.col("event_type") == "experiment_timeout").alias("_t"))


def telemetry_switches(flags: DataFrame, counts: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Telemetry that is required but absent, or disabled but present."""
    df = flags.join(counts, list(keys), "left")
    has = lambda n: F.coalesce(F.col(n), F.lit(0)) > 0
    return findings(df, keys, F.col("run_id"), {
        "system_metrics_missing": (F.col("system_on") == 1) & ~has("system_rows"), "system_metrics_disabled_but_present": (F.col("system_on") == 0) & has("system_rows"),
        "runtime_metrics_disabled_but_present": (F.col("runtime_on") == 0) & has("runtime_rows"),
        "runtime_metrics_missing": (F.col("runtime_on") == 1) & ~has("runtime_rows"), "traces_missing": (F.col("traces_on") == 1) & ~has("trace_rows")})


def process_ids(samples: DataFrame, configs: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Recorded process ids against the configured ones, for each role, counted per run."""
    roles = ["server", "gateway", "dependency"]
    conf = configs.select(*keys, *[F.col(f"{r}_pid").cast("bigint").alias(f"_{r}") for r in roles])
    cells = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_pid").cast("bigint").alias("seen"), F.col(f"_{r}").alias("want")) for r in roles])
    rows = samples.join(conf, list(keys)).select(*keys, F.explode(cells).alias("p")).select(*keys, "p.*")
    return rows.withColumn("code", process_fault(F.col("seen"), F.col("want"))).where("code is not null").groupBy(*keys, "role", "code").agg(F.count(F.lit(1)).alias("rows"))


def process_fault(seen: Column, want: Column) -> Column:
    return F.when(want.isNull() & seen.isNotNull(), "unexpected_process").when(want.isNotNull() & ~seen.eqNullSafe(want), "pid_mismatch")


def version_issues(manifests: DataFrame, supported: Sequence[str], keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    return findings(manifests, keys, F.col("run_id"), {
        "artifact_version_mismatch": ~F.coalesce(F.col("artifact_version").isin(*supported), F.lit(False)),
        "unknown_schema_version": ~F.coalesce(F.col("config_version").isin(*supported), F.lit(False))})


def condition_agreement(configs: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Condition labels against the run's configuration: prompts, tokens, rate, delay, degree, levels."""
    has = lambda label: F.array_contains("active_mechanisms", label)
    gap = F.abs(F.col("inter_arrival_seconds") - F.lit(1.0 / 12.0)) < 1e-9
    rules = {
        "input_profile_mismatch": has("input_medium") & (F.col("prompt_profile") != "synthetic-input-medium"),
        "output_target_mismatch": has("output_32") & ~((F.col("prompt_profile") == "synthetic-continuation") & (F.col("target_output_tokens") == 32)),
        "load_rate_mismatch": has("load_12rps") & ~gap,
        "downstream_delay_mismatch": has("downstream_100ms") & (F.coalesce("dependency_delay_ms", F.lit(0)) != 100),
        "degree_mismatch": F.col("compound_degree") != F.size("active_mechanisms"),
        "level_keys_mismatch": F.array_sort(F.map_keys("mechanism_levels")) != F.array_sort("active_mechanisms"),
    }
    return findings(configs, keys, F.col("run_id"), rules)


def config_issues(configs: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Rules over parsed configuration rows."""
    c = F.col
    cpu, down = c("mechanism_type") == "cpu_contention", c("mechanism_type") == "downstream_latency"
    rules = {
        "run_id_empty": F.coalesce(c("run_id"), F.lit("")) == "",
        "request_count_negative": c("request_count") < 0, "concurrency_below_one": c("concurrency") < 1,
        "inter_arrival_negative": c("inter_arrival_seconds") < 0, "burst_size_below_one": c("burst_size") < 1,
        "burst_interval_negative": c("burst_interval_seconds") < 0, "target_tokens_negative": c("target_output_tokens") < 0,
        "jitter_negative": c("output_jitter_tokens") < 0, "start_offset_negative": c("start_offset_seconds") < 0,
        "unknown_arrival_pattern": ~c("arrival_pattern").isin("constant_open_loop", "burst", "batched_arrival"),
        "unknown_prompt_profile": ~c("prompt_profile").isin("synthetic-input-small", "synthetic-input-medium", "synthetic-continuation"),
        "unsupported_output_profile": c("output_profile") != "fixed", "unknown_runtime_type": ~c("runtime_type").isin("mock", "llamacpp"),
        "base_url_missing": (c("runtime_type") == "llamacpp") & (F.coalesce(c("base_url"), F.lit("")) == ""),
        "outstanding_below_one": (c("runtime_type") == "llamacpp") & (c("max_outstanding_requests") < 1),
        "request_telemetry_off": (c("runtime_type") == "llamacpp") & (c("request_telemetry") == 0),
        "schedule_negative": (c("scheduled_onset") < 0) | (c("scheduled_duration") < 0),
        "cpu_target": cpu & (c("target") != "host_cpu"), "cpu_intensity": cpu & ~((c("intensity") > 0) & (c("intensity") <= 1)),
        "cpu_over_limit": cpu & (c("intensity") > c("maximum_cpu_stress")),
        "downstream_target": down & (c("target") != "synthetic_dependency"), "downstream_delay_negative": down & (c("delay_ms") < 0),
        "downstream_delay_over_limit": down & (c("delay_ms") > c("maximum_dependency_delay_ms")),
        "cpu_limit_negative": c("maximum_cpu_stress") < 0, "timeout_not_positive": c("experiment_timeout") <= 0,
        "delay_limit_negative": c("maximum_dependency_delay_ms") < 0, "watchdog_not_positive": c("watchdog_interval") <= 0,
    }
    return findings(configs, keys, c("run_id"), rules)


def design_audit(runs: DataFrame, known_conditions: Sequence[str], repetitions: int) -> DataFrame:
    """Missing (condition, repetition) cells, duplicate cells, unknown conditions, per campaign.

    The expected cells of a campaign are a fixed list, joined away from what was seen.
    """
    seen = runs.groupBy("campaign_id", "condition_id", "repetition").agg(F.count(F.lit(1)).alias("_c"))
    cells = F.array(*[F.struct(F.lit(c).alias("condition_id"), F.lit(r).alias("repetition")) for c in known_conditions for r in range(1, repetitions + 1)])
    expected = runs.select("campaign_id").distinct().select("campaign_id", F.explode(cells).alias("e")).select("campaign_id", "e.*")
    keys = ["campaign_id", "condition_id", "repetition"]
    missing = expected.join(seen, keys, "left_anti").withColumn("code", F.lit("missing_repetition"))
    double = seen.where("_c > 1").select(*keys, F.lit("duplicate_cell").alias("code"))
    strange = seen.where(~F.col("condition_id").isin(*known_conditions)).select(*keys, F.lit("unknown_condition").alias("code"))
    return missing.unionByName(double).unionByName(strange)


def cost_preflight(runs: DataFrame, keys: Sequence[str], cell: Sequence[str], expected: int) -> DataFrame:
    """Row count, unique cells and telemetry switches of a cost campaign."""
    per = runs.groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(F.sum("_c").alias("_rows"), F.count_if(F.col("_c") > 1).alias("_dup"))
    return findings(per, keys, F.lit("campaign"), {"unexpected_row_count": F.col("_rows") != expected, "duplicate_cost_cell": F.col("_dup") > 0})


def verdicts(runs: DataFrame, issues: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """A run is valid when it has no issue. Issues are counted on the map side."""
    counts = issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("issues"))
    out = runs.join(counts, list(keys), "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    return out.withColumn("valid", (F.col("issues") == 0).cast("int"))
