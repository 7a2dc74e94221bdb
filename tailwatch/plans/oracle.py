"""Shared tables of the reference SQL, as common table expressions over the driver's tables."""

from __future__ import annotations

import re

from ..functions.student import normal_quantile, quantile_table
from ..operators.csd import EXTENDED_FEATURES, PRIMARY_FEATURES
from ..operators.derive import SLO_LIMITS
from ..operators.design import COMPARISONS, CELLS, CONDITIONS, FACTORIAL
from ..operators.runs import DIRECT_EVIDENCE, QUEUE_METRICS, SUMMARY_METRICS
from ..sources.driver_views import METRIC_COLUMNS, REQUEST_STAGES, SYSTEM_COLUMNS

RUN = "campaign_id, condition_id, repetition, run_id"


def r6(expr: str) -> str:
    return f"CASE WHEN abs({expr}) < 1e-3 THEN floor(({expr}) * 1e9 + 0.50013::DOUBLE) / 1e9 ELSE floor(({expr}) * 1e6 + 0.50013::DOUBLE) / 1e6 END"


def values(rows: list[tuple], names: str) -> str:
    def lit(x):
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)

    body = ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({names})"


def t_table(p: float, size: int = 60) -> str:
    return "[" + ", ".join(f"{x!r}::DOUBLE" for x in quantile_table(p)[:size]) + "]"


T975, T95 = t_table(0.975), t_table(0.95)


def t_half(n: str, sd: str) -> str:
    return f"({T975}[CAST({n} - 1 AS INT)] * {sd} / sqrt({n}))"


def t7_p(t: str) -> str:
    """Two-sided t tail for seven degrees of freedom (eight repetitions), in closed form."""
    th = f"atan(abs({t}) / sqrt(7::DOUBLE))"
    s, c = f"sin({th})", f"cos({th})"
    return f"(1 - 2 / pi() * ({th} + {s} * ({c} + 2e0 / 3e0 * pow({c}, 3) + 8e0 / 15e0 * pow({c}, 5))))"


def uniform(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296e0)"


def _request_sql() -> str:
    sql = "events"
    for stage in REQUEST_STAGES:
        cols = ", ".join(e.replace("{k}", "(props::JSON ->> '$.k')") + (f" AS {n}" if n != "*" else "") for n, e in stage)
        sql = f"(SELECT {cols} FROM {sql})"
    return sql[1:-1]


def _select(columns: list[tuple[str, str]], source: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns)} FROM {source}"


def _q(col: str, stem: str, ps: str = "median p95") -> str:
    at = {"median": 0.5, "p95": 0.95}
    return ", ".join(f"quantile_cont({col}, {at[p]}) AS {stem}_{p}" for p in ps.split())


def _span(name: str, start: str, end: str, root: bool) -> str:
    ident = lambda n, tag: f"substr(sha256(concat_ws('|', request_id, '{tag}')), 1, {n})"
    parent = "NULL" if root else ident(16, "gateway request")
    return (
        f"SELECT {RUN}, event_id, request_id, {ident(32, 'trace')} AS trace_id, {ident(16, name)} AS span_id, {parent} AS parent_span_id, "
        f"'{name}' AS span_name, {start} AS start_time, {end} AS end_time, {end} - {start} AS duration, 'ok' AS status FROM req "
        "WHERE gateway_receive_time IS NOT NULL AND dependency_start_time IS NOT NULL AND dependency_end_time IS NOT NULL "
        "AND llama_dispatch_time IS NOT NULL AND gateway_completion_time IS NOT NULL"
    )


def unpivot_sql(source: str, keys: str, columns: list[str], name: str = "feature") -> str:
    parts = " UNION ALL ".join(f"SELECT {keys}, '{c}' AS {name}, CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns)
    return parts


def _residuals(scale: str, features: list[str]) -> str:
    names = ", ".join(f"'{f}'" for f in features)
    return (f"SELECT q.campaign_id, q.compound, q.metric AS feature, q.repetition, q.a0b0, q.a1b0, q.a0b1, q.a1b1, s.scale, q.a1b0 + q.a0b1 - q.a0b0 AS predicted, "
            f"q.a1b1 - q.a1b0 - q.a0b1 + q.a0b0 AS delta, (q.a1b1 - q.a1b0 - q.a0b1 + q.a0b0) / s.scale AS z FROM quads q JOIN {scale} s "
            f"ON s.campaign_id = q.campaign_id AND s.compound = q.compound AND s.feature = q.metric WHERE q.metric IN ({names}) AND s.scale > 1e-12")


def _means(source: str) -> str:
    return ("SELECT campaign_id, compound, feature, avg(a0b0) AS control_mean, avg(a1b0) AS a_only_mean, avg(a0b1) AS b_only_mean, avg(a1b1) AS observed_mean, "
            f"avg(predicted) AS predicted_mean, avg(delta) AS raw_residual, avg(z) AS zbar, max(scale) AS scale FROM {source} GROUP BY campaign_id, compound, feature")


_flags = {"ttft_p95": "ttft_slo_violated", "total_latency_p95": "total_latency_slo_violated", "post_first_token_duration_p95": "decode_duration_slo_violated"}

TABLES: dict[str, str] = {
    "req": _request_sql(),
    "sysm": _select(SYSTEM_COLUMNS, "req"),
    "rtm": _select(METRIC_COLUMNS, "req"),
    "spans": " UNION ALL ".join([
        _span("gateway request", "gateway_receive_time", "gateway_completion_time", True),
        _span("dependency call", "dependency_start_time", "dependency_end_time", False),
        _span("llama call", "llama_dispatch_time", "gateway_completion_time", False),
    ]),
    "lat": "SELECT *, CASE WHEN status = 'success' THEN first_token_time - actual_arrival END AS ttft, "
           "CASE WHEN status = 'success' THEN completion_time - actual_arrival END AS total_latency, "
           "CASE WHEN status = 'success' THEN completion_time - first_token_time END AS post_first_token_duration FROM req",
    "reqagg": f"SELECT {RUN}, {_q('ttft', 'ttft')}, {_q('total_latency', 'total_latency')}, "
              f"{_q('post_first_token_duration', 'post_first_token_duration')}, {_q('scheduler_slip', 'scheduler_slip', 'p95')}, "
              f"{_q('CAST(server_prompt_tokens AS DOUBLE)', 'server_prompt_tokens')}, {_q('CAST(server_output_tokens AS DOUBLE)', 'server_output_tokens')}, "
              f"{_q('dependency_duration', 'dependency_duration')}, "
              "count(*) FILTER (WHERE status = 'success') AS successful_requests, count(*) FILTER (WHERE status = 'failed') AS failed_requests, "
              "count(*) FILTER (WHERE status = 'admission_failed') AS admission_failed, count(*) AS measured_request_count, "
              "CASE WHEN max(completion_time) > min(actual_arrival) THEN count(*) FILTER (WHERE status = 'success') / (max(completion_time) - min(actual_arrival)) END AS successful_requests_per_second, "
              f"count(*) FILTER (WHERE status = 'success') / count(*)::DOUBLE AS completion_fraction FROM lat GROUP BY {RUN}",
    "sysagg": f"SELECT {RUN}, max(server_process_rss_bytes) AS server_rss_max, {_q('host_cpu_percent', 'host_cpu')}, "
              f"{_q('server_process_cpu_percent', 'server_cpu')}, {_q('server_process_rss_bytes', 'server_rss', 'median')} FROM sysm GROUP BY {RUN}",
    "qagg": f"SELECT {RUN}, max(metric_value) FILTER (WHERE metric_name = 'requests_deferred') AS requests_deferred_max, "
            "max(metric_value) FILTER (WHERE metric_name = 'requests_processing') AS requests_processing_max, "
            "median(metric_value) FILTER (WHERE metric_name = 'requests_deferred') AS requests_deferred_median, "
            f"median(metric_value) FILTER (WHERE metric_name = 'requests_processing') AS requests_processing_median FROM rtm GROUP BY {RUN}",
    "tmap": f"SELECT {RUN}, request_id, max(duration) FILTER (WHERE span_name = 'gateway request') AS gateway_span_duration, "
            "max(duration) FILTER (WHERE span_name = 'dependency call') AS dependency_span_duration, "
            f"max(duration) FILTER (WHERE span_name = 'llama call') AS llama_span_duration, count(*) AS span_count FROM spans GROUP BY {RUN}, request_id",
    "tagg": f"SELECT {RUN}, CAST(sum(span_count) AS BIGINT) AS trace_row_count, {_q('gateway_span_duration', 'gateway_span_duration')}, "
            f"{_q('dependency_span_duration', 'dependency_span_duration')}, {_q('llama_span_duration', 'llama_span_duration')}, "
            "median(dependency_span_duration / gateway_span_duration) AS dependency_fraction_of_gateway_median, "
            f"median(llama_span_duration / gateway_span_duration) AS llama_fraction_of_gateway_median FROM tmap GROUP BY {RUN}",
    "runs0": f"SELECT * FROM reqagg LEFT JOIN sysagg USING ({RUN}) LEFT JOIN qagg USING ({RUN}) LEFT JOIN tagg USING ({RUN})",
    "runs": "SELECT *, CASE slo_violation_count WHEN 0 THEN 'NO_COUNTED_SLO_VIOLATION' WHEN 1 THEN 'SINGLE_SLO_VIOLATION' ELSE 'COMPOUND_SLO_VIOLATION' END AS slo_violation_class FROM ("
            "SELECT *, ttft_slo_violated + total_latency_slo_violated + decode_duration_slo_violated AS slo_violation_count FROM (SELECT *, "
            + ", ".join(f"CASE WHEN {m} > {x!r}::DOUBLE THEN 1 ELSE 0 END AS {_flags[m]}" for m, x in SLO_LIMITS.items()) + " FROM runs0))",
    "cond": values([(c["condition_id"], c["mechanism_family"], c["compound_degree"], c["expected_control_id"], c["target_output_tokens"],
                     c["inter_arrival_seconds"], c["prompt_profile"], i) for i, c in enumerate(CONDITIONS)],
                   "condition_id, mechanism_family, compound_degree, expected_control_id, target_output_tokens, inter_arrival_seconds, prompt_profile, cidx"),
    "cells": values([(comp, cell, c) for comp, cs in FACTORIAL.items() for cell, c in zip(CELLS, cs)], "compound, cell, condition_id"),
    "comparisons": values(COMPARISONS, "mechanism, condition, control, primary_metric, direct_metric"),
    "evspec": values([(c, m) for c, extra in DIRECT_EVIDENCE.items() for m in [*extra, *QUEUE_METRICS]], "condition_id, metric"),
    "rlong": unpivot_sql("runs", RUN, SUMMARY_METRICS, "metric"),
    "pairs": "SELECT t.campaign_id, t.repetition, m.mechanism, m.condition, m.control, m.primary_metric, m.direct_metric, t.value AS y, k.value AS x, "
             "t.value - k.value AS delta, t.value / nullif(k.value, 0) AS ratio FROM comparisons m "
             "JOIN rlong t ON t.condition_id = m.condition AND t.metric = m.primary_metric "
             "JOIN rlong k ON k.condition_id = m.control AND k.metric = m.primary_metric AND k.campaign_id = t.campaign_id AND k.repetition = t.repetition",
    "quads": "SELECT * FROM (SELECT campaign_id, compound, metric, repetition, max(value) FILTER (WHERE cell = 'A0B0') AS a0b0, max(value) FILTER (WHERE cell = 'A1B0') AS a1b0, "
             "max(value) FILTER (WHERE cell = 'A0B1') AS a0b1, max(value) FILTER (WHERE cell = 'A1B1') AS a1b1 FROM rlong JOIN cells USING (condition_id) "
             "GROUP BY campaign_id, compound, metric, repetition) WHERE a0b0 IS NOT NULL AND a1b0 IS NOT NULL AND a0b1 IS NOT NULL AND a1b1 IS NOT NULL",
    "inter": f"SELECT *, CASE WHEN ci_low > 0 THEN 'SUPER_ADDITIVE_EVIDENCE' WHEN ci_high < 0 THEN 'SUB_ADDITIVE_EVIDENCE' ELSE 'INTERACTION_UNCERTAIN' END AS classification FROM ("
             f"SELECT *, mean - {t_half('n', 'sd')} AS ci_low, mean + {t_half('n', 'sd')} AS ci_high, CASE WHEN sd > 1e-12 THEN mean / sd END AS dz, "
             "CASE WHEN sd > 1e-12 THEN mean / (sd / sqrt(n)) END AS t_statistic FROM ("
             "SELECT campaign_id, compound, metric, count(*) AS n, avg(a1b1 - a1b0 - a0b1 + a0b0) AS mean, stddev_samp(a1b1 - a1b0 - a0b1 + a0b0) AS sd, "
             "min(a1b1 - a1b0 - a0b1 + a0b0) AS min, max(a1b1 - a1b0 - a0b1 + a0b0) AS max FROM quads WHERE metric IN ('ttft_p95', 'total_latency_p95', 'post_first_token_duration_p95') "
             "GROUP BY campaign_id, compound, metric))",
    "cellstat": "SELECT campaign_id, compound, metric AS feature, cell, count(value) AS n, var_samp(value) AS v, median(value) AS centre FROM rlong JOIN cells USING (condition_id) "
                "WHERE value IS NOT NULL GROUP BY campaign_id, compound, metric, cell",
    "sdscale": "SELECT campaign_id, compound, feature, coalesce(sqrt(sum((n - 1) * v) FILTER (WHERE n >= 2) / sum(n - 1) FILTER (WHERE n >= 2)), 0) AS scale FROM cellstat GROUP BY campaign_id, compound, feature",
    "madscale": "SELECT campaign_id, compound, feature, sqrt(sum(n * pow(14826e-4 * mad, 2)) / sum(n)) AS scale FROM ("
                "SELECT r.campaign_id, c.compound, r.metric AS feature, c.cell, count(*) AS n, median(abs(r.value - s.centre)) AS mad FROM rlong r JOIN cells c USING (condition_id) "
                "JOIN cellstat s ON s.campaign_id = r.campaign_id AND s.compound = c.compound AND s.feature = r.metric AND s.cell = c.cell WHERE r.value IS NOT NULL GROUP BY ALL) GROUP BY campaign_id, compound, feature",
    "res": _residuals("sdscale", PRIMARY_FEATURES),
    "resmad": _residuals("madscale", PRIMARY_FEATURES),
    "resext": _residuals("sdscale", PRIMARY_FEATURES + EXTENDED_FEATURES),
    "fmeans": _means("res"), "fmeansmad": _means("resmad"), "fmeansext": _means("resext"),
    "csds": "SELECT campaign_id, compound, sqrt(avg(zbar * zbar)) AS csd, count(*) AS feature_count FROM fmeans GROUP BY campaign_id, compound",
}


def with_tables(body: str, doubles: list[str]) -> str:
    """Prepend the shared tables the body uses, directly or not, and round the named columns."""
    need: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, sql in TABLES.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(sql)
    ctes = [f"{n} AS MATERIALIZED ({s})" for n, s in TABLES.items() if n in need]
    rounded = f"SELECT * REPLACE ({', '.join(f'{r6(d)} AS {d}' for d in doubles)}) FROM ({body}) AS answer" if doubles else f"SELECT * FROM ({body}) AS answer"
    return (f"WITH {', '.join(ctes)} " if ctes else "") + rounded
