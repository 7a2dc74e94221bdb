"""Queries over ordered request series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..operators import temporal as T
from ..operators.degrade import DELAY_LEVELS, SAMPLING_LEVELS
from . import tables as V
from .oracle import RUN as RUN_SQL
from .oracle import TABLES, uniform, unpivot_sql
from .registry import query

TABLES["ser"] = f"""SELECT {RUN_SQL}, r.request_id, r.sequence AS ordinal, row_number() OVER w AS rn, count(*) OVER (PARTITION BY run_id) AS n,
  first_token_time - actual_arrival AS ttft, completion_time - actual_arrival AS total_latency, completion_time - first_token_time AS post_first_token_duration,
  coalesce(nullif(llama_first_token_time, 0), first_token_time) - coalesce(nullif(llama_dispatch_time, 0), actual_arrival) AS prefill_proxy, dependency_duration, scheduler_slip,
  gateway_span_duration, llama_span_duration, dependency_span_duration
  FROM req r LEFT JOIN tmap USING ({RUN_SQL}, request_id) WINDOW w AS (PARTITION BY run_id ORDER BY r.sequence)"""
TABLES["serlong"] = unpivot_sql("ser", f"{RUN_SQL}, ordinal, rn, n", T.SERIES_METRICS, "metric")
TABLES["el10"] = f"""SELECT {RUN_SQL}, metric, max(n) AS n, median(value) FILTER (WHERE rn <= 10) AS early_median, median(value) FILTER (WHERE rn > n - 10) AS late_median,
  median(value) FILTER (WHERE rn > n - 10) - median(value) FILTER (WHERE rn <= 10) AS late_minus_early,
  CASE WHEN count(value) = count(*) AND count(*) >= 2 THEN regr_slope(value, (rn - 1) / nullif(n - 1, 0)::DOUBLE) END AS normalized_slope FROM serlong GROUP BY {RUN_SQL}, metric"""


def _skip_slope(source: str, keys: str) -> str:
    return f"""SELECT {keys}, metric, CASE WHEN max(m) >= 2 THEN regr_slope(value, (r - 1) / nullif(m - 1, 0)::DOUBLE) END AS normalized_slope FROM (
      SELECT {keys}, metric, value, row_number() OVER (PARTITION BY {keys}, metric ORDER BY rn) AS r, count(*) OVER (PARTITION BY {keys}, metric) AS m FROM {source} WHERE value IS NOT NULL) GROUP BY {keys}, metric"""


def quarter_sql(source: str, keys: str = "run_id") -> str:
    q = "greatest(3, CAST(floor(n * 0.25) AS INT))"
    out = ", ".join(f"e.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {out}, e.metric, e.n, CASE WHEN fits THEN early_median END AS early_median, CASE WHEN fits THEN late_median END AS late_median,
      CASE WHEN fits THEN late_median - early_median END AS late_minus_early, CASE WHEN fits THEN s.normalized_slope END AS normalized_slope FROM (
        SELECT {keys}, metric, max(n) AS n, max(n) >= 2 * greatest(3, CAST(floor(max(n) * 0.25) AS INT)) AS fits, median(value) FILTER (WHERE rn <= {q}) AS early_median,
        median(value) FILTER (WHERE rn > n - {q}) AS late_median FROM {source} GROUP BY {keys}, metric) e LEFT JOIN ({_skip_slope(source, keys)}) s USING ({keys}, metric)"""


def series(spark, sf):
    """The ordered series of every run, kept for the session."""
    return V.keep("series", spark, sf, lambda: T.ordered_series(
        T.request_series(V.requests(spark, sf), R.trace_request_map(V.spans(spark, sf))), requests=V.requests(spark, sf)))


def positioned(spark, sf):
    return T.melt(series(spark, sf), T.RUN, ("ordinal", "rn", "n"))


@query(
    "ordered_series", "W1",
    f"SELECT request_id, ordinal, rn, n, {', '.join(T.SERIES_METRICS)} FROM ser", " ".join(T.SERIES_METRICS),
)
def ordered_series(spark, sf):
    return series(spark, sf).drop(*T.RUN)


@query("series_gate", "W1", f"SELECT {RUN_SQL}, count(*) AS requests, count(DISTINCT ordinal) AS distinct_ordinals, CASE WHEN count(*) = count(DISTINCT ordinal) AND count(*) = 40 THEN 1 ELSE 0 END AS series_ok FROM ser GROUP BY {RUN_SQL}")
def series_gate(spark, sf):
    return T.order_gate(series(spark, sf), expected=40)


_EL = "early_median late_median late_minus_early"


@query("early_late", "W2", f"SELECT {RUN_SQL}, metric, n, early_median, late_median, late_minus_early FROM el10", _EL)
def early_late(spark, sf):
    return T.early_late(positioned(spark, sf), T.RUN, 10)


@query("slope", "W3", f"SELECT {RUN_SQL}, metric, normalized_slope FROM el10", "normalized_slope")
def slope(spark, sf):
    return T.strict_slope(positioned(spark, sf), T.RUN)


@query("slope_skipnull", "W4", _skip_slope("serlong", "run_id"), "normalized_slope")
def slope_skipnull(spark, sf):
    return T.null_skipping_slope(positioned(spark, sf), T.RUN).select("run_id", "metric", "normalized_slope")


@query("quarter_window", "W5", quarter_sql("serlong"), _EL + " normalized_slope")
def quarter_window(spark, sf):
    return T.order_features(series(spark, sf), T.RUN).drop("campaign_id", "condition_id", "repetition")


_MASKED = f"""SELECT * EXCLUDE (u, k, m), row_number() OVER (PARTITION BY run_id, seed, severity ORDER BY ordinal) AS rn, count(*) OVER (PARTITION BY run_id, seed, severity) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, seed ORDER BY u, ordinal) AS k, count(*) OVER (PARTITION BY run_id, seed) AS m FROM (
    SELECT * EXCLUDE (rn, n, s), s + CAST(100 * (campaign_id % 2) AS INT) AS seed, {uniform('CAST(s + CAST(100 * (campaign_id % 2) AS INT) AS VARCHAR)', 'run_id', 'CAST(ordinal AS VARCHAR)')} AS u
    FROM ser, (SELECT unnest(range(8301, 8311))::INT AS s))), (SELECT unnest([0.75::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE]) AS severity)
  WHERE k <= greatest(1, CAST(round_even(m * severity, 0) AS INT))"""
TABLES["mask"] = _MASKED
TABLES["masklong"] = unpivot_sql("mask", "run_id, severity, seed, rn, n", T.SERIES_METRICS, "metric")
TABLES["osamp"] = quarter_sql("masklong", "run_id, severity, seed")
TABLES["latelong"] = "SELECT * REPLACE (rn + d AS rn), d::DOUBLE AS severity, 0 AS seed FROM serlong, (SELECT unnest([1, 3, 5]) AS d) WHERE rn + d <= n"
TABLES["odelay"] = quarter_sql("latelong", "run_id, severity, seed")


def sampled_order(spark, sf):
    """Order features of every run under every mask: fraction of requests kept, and seed."""
    def build():
        base = F.array(*[F.lit(s) for s in range(8301, 8311)])
        seeds = F.transform(base, lambda s: (s + 100 * (F.col("campaign_id") % 2)).cast("int"))
        grid = T.sampled_grid(series(spark, sf), T.RUN, SAMPLING_LEVELS, seeds)
        return T.order_features(grid, [*T.RUN, "seed", "severity"], order="ordinal", bound=series(spark, sf))

    return V.keep("sampled-order", spark, sf, build)


def delayed_order(spark, sf):
    """Order features of every run with values that come some positions late."""
    return V.keep("delayed-order", spark, sf, lambda: T.order_features(
        T.delayed_grid(series(spark, sf), DELAY_LEVELS), [*T.RUN, "severity"], bound=series(spark, sf)))


@query("degrade_delay", "R5 W10", "SELECT * EXCLUDE (seed) FROM odelay", _EL + " normalized_slope severity")
def degrade_delay(spark, sf):
    return delayed_order(spark, sf).drop("campaign_id", "condition_id", "repetition")


@query(
    "shifted_rows", "W10",
    "SELECT run_id, ordinal, lag(ttft, 3) OVER w AS ttft_late, lag(total_latency, 3) OVER w AS total_late FROM ser WINDOW w AS (PARTITION BY run_id ORDER BY ordinal)",
    "ttft_late total_late",
)
def shifted_rows(spark, sf):
    return T.shifted_rows(series(spark, sf), T.RUN, {"ttft_late": "ttft", "total_late": "total_latency"}, 3).select("run_id", "ordinal", "ttft_late", "total_late")


@query("degrade_sample", "R4", "SELECT * FROM osamp", _EL + " normalized_slope severity")
def degrade_sample(spark, sf):
    return sampled_order(spark, sf).drop("campaign_id", "condition_id", "repetition")


@query(
    "inflight_gauge", "X7",
    f"""SELECT {RUN_SQL}, request_id, arrival_time, outstanding, CASE WHEN outstanding > 8 THEN 1 ELSE 0 END AS breach FROM (
      SELECT *, CAST(sum(step) OVER (PARTITION BY run_id ORDER BY arrival_time, step, request_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS outstanding FROM (
        SELECT {RUN_SQL}, request_id, actual_arrival AS arrival_time, 1 AS step FROM req WHERE completion_time IS NOT NULL
        UNION ALL SELECT {RUN_SQL}, request_id, completion_time, -1 FROM req WHERE completion_time IS NOT NULL)) WHERE step = 1""",
    "arrival_time",
)
def inflight_gauge(spark, sf):
    return T.in_flight(V.requests(spark, sf), cap=8).withColumnRenamed("at", "arrival_time")
