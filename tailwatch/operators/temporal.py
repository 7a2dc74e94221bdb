"""Ordered per-run request series and the features taken from them.

Series are held long, ``(run keys, metric, ordinal, value)``, so that one pass serves every metric.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import portable_uniform
from .derive import prefill_proxy
from .grouped import HOT_ROWS, grouped_stats, hot_groups
from .ordered import with_lag, with_rank

RUN = ["campaign_id", "condition_id", "repetition", "run_id"]
SERIES_METRICS = [
    "ttft", "total_latency", "post_first_token_duration", "prefill_proxy", "dependency_duration", "scheduler_slip",
    "gateway_span_duration", "llama_span_duration", "dependency_span_duration",
]


def request_series(requests: DataFrame, trace_map: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """One row per request with its nine series values; the join key includes the request."""
    c = F.col
    wide = requests.select(
        *keys, "request_id", F.regexp_extract("request_id", r"-(\d+)$", 1).cast("bigint").alias("ordinal"),
        (c("first_token_time") - c("actual_arrival")).alias("ttft"),
        (c("completion_time") - c("actual_arrival")).alias("total_latency"),
        (c("completion_time") - c("first_token_time")).alias("post_first_token_duration"),
        prefill_proxy().alias("prefill_proxy"), "dependency_duration", "scheduler_slip",
    )
    return wide.join(trace_map.drop("span_count"), [*keys, "request_id"], "left")


def ordered_series(series: DataFrame, keys: list[str] = RUN, hot_rows: int | None = None, requests: DataFrame | None = None) -> DataFrame:
    """Add each request's position and the size of its run. ``requests`` are those of the series, a row each."""
    return with_rank(series, keys, ["ordinal"], "rn", "n", hot_rows, requests)


def melt(series: DataFrame, keys: list[str], extra: Sequence[str] = ("ordinal",), metrics: Sequence[str] = tuple(SERIES_METRICS)) -> DataFrame:
    return series.unpivot([*keys, *extra], list(metrics), "metric", "value")


def order_gate(series: DataFrame, keys: list[str] = RUN, expected: int | None = None) -> DataFrame:
    """Requests per run and whether ordinals are distinct (and as many as expected)."""
    out = series.groupBy(*keys, "ordinal").agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(
        F.sum("_c").alias("requests"), F.count(F.lit(1)).alias("distinct_ordinals"))
    fine = F.col("requests") == F.col("distinct_ordinals")
    if expected is not None:
        fine = fine & (F.col("requests") == expected)
    return out.withColumn("series_ok", fine.cast("int"))


def early_late(positioned: DataFrame, keys: list[str], window: Column | int, hot_rows: int | None = None) -> DataFrame:
    """Medians of the first and last ``window`` positions per (run, metric), nulls skipped.

    ``positioned`` is long with ``rn`` and ``n``; ``window`` may be a column, such as a quarter of n.
    """
    k = F.lit(window) if isinstance(window, int) else window
    df = positioned.withColumns({
        "_early": F.when(F.col("rn") <= k, F.col("value")), "_late": F.when(F.col("rn") > F.col("n") - k, F.col("value")),
    })
    out = grouped_stats(df, [*keys, "metric"], [F.max("n").alias("n")], {"_early": {"early_median": 0.5}, "_late": {"late_median": 0.5}}, hot_rows)
    return out.withColumn("late_minus_early", F.col("late_median") - F.col("early_median"))


def strict_slope(positioned: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares slope over the position scaled to [0, 1]; null if any value is missing.

    The regression aggregate keeps sums only, so it combines on the map side.
    """
    x = (F.col("rn") - 1) / F.nullif(F.col("n") - 1, F.lit(0))
    out = positioned.groupBy(*keys, "metric").agg(
        F.regr_slope("value", x).alias("_s"), F.count("value").alias("_v"), F.count(F.lit(1)).alias("_n"))
    return out.select(*keys, "metric", F.when((F.col("_v") == F.col("_n")) & (F.col("_n") >= 2), F.col("_s")).alias("normalized_slope"))


def null_skipping_slope(positioned: DataFrame, keys: list[str], order: str = "rn", hot_rows: int | None = None) -> DataFrame:
    """Slope over the surviving values, respaced evenly over [0, 1]."""
    alive = with_rank(positioned.where("value is not null").select(*keys, "metric", order, "value"), [*keys, "metric"], [order], "_r", "_m", hot_rows)
    x = (F.col("_r") - 1) / F.nullif(F.col("_m") - 1, F.lit(0))
    return alive.groupBy(*keys, "metric").agg(F.regr_slope("value", x).alias("_s"), F.max("_m").alias("_m")).select(
        *keys, "metric", F.when(F.col("_m") >= 2, F.col("_s")).alias("normalized_slope"))


def quarter(n: Column) -> Column:
    return F.greatest(F.lit(3), F.floor(n * 0.25).cast("int"))


def quarter_features(positioned: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """Early and late medians over a quarter of the run with the null-skipping slope; all null when
    two quarters do not fit."""
    q = quarter(F.col("n"))
    medians = early_late(positioned, keys, q, hot_rows)
    out = medians.join(null_skipping_slope(positioned, keys, hot_rows=hot_rows), [*keys, "metric"], "left")
    fits = F.col("n") >= 2 * q
    return out.select(*keys, "metric", "n", *[F.when(fits, F.col(c)).alias(c) for c in ("early_median", "late_median", "late_minus_early", "normalized_slope")])


def order_features(series: DataFrame, keys: list[str], metrics: Sequence[str] = tuple(SERIES_METRICS), hot_rows: int | None = None,
                   order: str = "rn", bound: DataFrame | None = None) -> DataFrame:
    """``quarter_features`` of all metrics from one ordering: keys, metric, n and the four statistics.

    ``series`` has a row per position (rn, n) with a column per metric. One window counts the values met so far of every
    metric, one group-by takes medians and regression sums; a slope over ranks becomes one over [0, 1] by the number of
    ranks. Groups that do not fit a task go the melted way, which splits them. ``order`` is a column that orders as rn does
    and may be the one that rows are sorted by already; ``bound`` as in ``hot_groups``.
    """
    if hot_groups(series, keys, HOT_ROWS if hot_rows is None else hot_rows, bound)[1] > 0:
        return quarter_features(melt(series, keys, ("rn", "n"), metrics), keys, hot_rows)
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    q = quarter(F.col("n"))
    seen = series.withColumns({f"_r_{m}": F.count(m).over(upto) for m in metrics})
    aggs = []
    for m in metrics:
        early, late = F.when(F.col("rn") <= q, F.col(m)), F.when(F.col("rn") > F.col("n") - q, F.col(m))
        aggs += [F.percentile(early, 0.5).alias(f"_e_{m}"), F.percentile(late, 0.5).alias(f"_l_{m}"), F.count(m).alias(f"_m_{m}"),
                 F.regr_slope(F.col(m), F.col(f"_r_{m}").cast("double")).alias(f"_s_{m}")]
    wide = seen.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    fits = F.col("n") >= 2 * q
    entry = lambda m: F.struct(
        F.lit(m).alias("metric"), F.when(fits, F.col(f"_e_{m}")).alias("early_median"), F.when(fits, F.col(f"_l_{m}")).alias("late_median"),
        F.when(fits, F.col(f"_l_{m}") - F.col(f"_e_{m}")).alias("late_minus_early"),
        F.when(fits & (F.col(f"_m_{m}") >= 2), F.col(f"_s_{m}") * (F.col(f"_m_{m}") - 1)).alias("normalized_slope"))
    return wide.select(*keys, "n", F.explode(F.array(*[entry(m) for m in metrics])).alias("_o")).select(*keys, "_o.metric", "n", *[f"_o.{c}" for c in (
        "early_median", "late_median", "late_minus_early", "normalized_slope")])


def window_features(series: DataFrame, keys: list[str], windows: Sequence[int], metrics: Sequence[str] = tuple(SERIES_METRICS), hot_rows: int | None = None) -> DataFrame:
    """``fixed_window_features`` for every length in ``windows``, as column ``k``, from one group-by of the series' wide rows:
    neither metrics nor lengths multiply rows before the shuffle. Groups that do not fit a task go the melted way."""
    if hot_groups(series, keys, HOT_ROWS if hot_rows is None else hot_rows)[1] > 0:
        grown = melt(series, keys, ("rn", "n"), metrics).withColumn("k", F.explode(F.array(*[F.lit(k) for k in windows])))
        return early_late(grown, [*keys, "k"], F.col("k"), hot_rows).join(strict_slope(grown, [*keys, "k"]), [*keys, "k", "metric"], "left")
    x = (F.col("rn") - 1) / F.nullif(F.col("n") - 1, F.lit(0))
    aggs = [F.max("n").alias("n"), F.count(F.lit(1)).alias("_rows")]
    for m in metrics:
        aggs += [F.regr_slope(F.col(m), x).alias(f"_s_{m}"), F.count(m).alias(f"_v_{m}")]
        for k in windows:
            early, late = F.when(F.col("rn") <= k, F.col(m)), F.when(F.col("rn") > F.col("n") - k, F.col(m))
            aggs += [F.percentile(early, 0.5).alias(f"_e{k}_{m}"), F.percentile(late, 0.5).alias(f"_l{k}_{m}")]
    wide = series.groupBy(*keys).agg(*aggs)
    entry = lambda m, k: F.struct(
        F.lit(m).alias("metric"), F.lit(k).alias("k"), F.col(f"_e{k}_{m}").alias("early_median"), F.col(f"_l{k}_{m}").alias("late_median"),
        (F.col(f"_l{k}_{m}") - F.col(f"_e{k}_{m}")).alias("late_minus_early"),
        F.when((F.col(f"_v_{m}") == F.col("_rows")) & (F.col("_rows") >= 2), F.col(f"_s_{m}")).alias("normalized_slope"))
    return wide.select(*keys, "n", F.explode(F.array(*[entry(m, k) for m in metrics for k in windows])).alias("_o")).select(*keys, "n", "_o.*")


def fixed_window_features(positioned: DataFrame, keys: list[str], window: int = 10, hot_rows: int | None = None) -> DataFrame:
    return early_late(positioned, keys, window, hot_rows).join(strict_slope(positioned, keys), [*keys, "metric"], "left")


def delayed(positioned: DataFrame, keys: list[str], shift: int) -> DataFrame:
    """Values arrive ``shift`` positions late: a prefix of nulls, and the tail falls off.

    With positions known this is a change of position, so no window is needed: rows pushed past the
    end drop out, and the first ``shift`` positions simply have no row.
    """
    moved = positioned.withColumn("rn", F.col("rn") + shift)
    return moved.where(F.col("rn") <= F.col("n"))


def shifted_rows(series: DataFrame, keys: list[str], columns: dict[str, str], shift: int, hot_rows: int | None = None) -> DataFrame:
    """The same delay with the null prefix kept as rows."""
    return with_lag(series, keys, ["ordinal"], columns, shift, hot_rows)


def subsampled(series: DataFrame, keys: list[str], fraction: float, seed: int, hot_rows: int | None = None) -> DataFrame:
    """Keep round(n * fraction) requests of each run, chosen by a portable hash, in their old order."""
    drawn = series.withColumn("_u", portable_uniform(seed, F.col("run_id"), F.col("ordinal")))
    ranked = with_rank(drawn, keys, ["_u", "ordinal"], "_k", "_n", hot_rows)
    kept = ranked.where(F.col("_k") <= F.greatest(F.lit(1), F.bround(F.col("_n") * fraction).cast("int"))).drop("_u", "_k", "_n")
    return with_rank(kept, keys, ["ordinal"], "rn", "n", hot_rows)


def sampled_grid(series: DataFrame, keys: list[str], fractions: Sequence[float], seeds: Column, hot_rows: int | None = None) -> DataFrame:
    """``subsampled`` for every seed and fraction at once: adds seed and severity, renews rn and n.

    Each seed orders a run's requests once; the fractions take longer and longer prefixes of that order, so they are nested.
    Rows are dealt by run before seeds and fractions multiply them; no later step shuffles them again.
    """
    dealt = series.drop("rn", "n").repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    drawn = dealt.withColumn("seed", F.explode(seeds)).withColumn("_u", portable_uniform(F.col("seed"), F.col("run_id"), F.col("ordinal")))
    ranked = with_rank(drawn, [*keys, "seed"], ["_u", "ordinal"], "_k", "_n", hot_rows, series)
    some = ranked.withColumn("severity", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    kept = some.where(F.col("_k") <= F.greatest(F.lit(1), F.bround(F.col("_n") * F.col("severity")).cast("int"))).drop("_u", "_k", "_n")
    return with_rank(kept, [*keys, "seed", "severity"], ["ordinal"], "rn", "n", hot_rows, series)


def delayed_grid(series: DataFrame, shifts: Sequence[int]) -> DataFrame:
    """``delayed`` for every shift at once: adds severity, moves rn."""
    moved = series.withColumn("_d", F.explode(F.array(*[F.lit(d) for d in shifts]))).withColumn("rn", F.col("rn") + F.col("_d"))
    return moved.where(F.col("rn") <= F.col("n")).withColumn("severity", F.col("_d").cast("double")).drop("_d")


def in_flight(requests: DataFrame, keys: list[str] = RUN, cap: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Requests outstanding just after each arrival, from +1/-1 events in time order; completions at
    the same instant count first."""
    from .ordered import with_running_sum

    started = requests.where("actual_arrival is not null and completion_time is not null")
    steps = F.array(
        F.struct(F.col("actual_arrival").alias("at"), F.lit(1).alias("step")),
        F.struct(F.col("completion_time").alias("at"), F.lit(-1).alias("step")),
    )
    moves = started.select(*keys, "request_id", F.explode(steps).alias("e")).select(*keys, "request_id", "e.at", "e.step")
    out = with_running_sum(moves, keys, ["at", "step", "request_id"], "step", "outstanding", hot_rows).where("step = 1").drop("step")
    return out.withColumn("breach", (F.col("outstanding") > cap).cast("int")) if cap is not None else out
