"""Matched effects, interactions, intervals, tests and limits over run-level tables.

Everything is keyed by campaign, so many campaigns run side by side. Run-level values are held
long: ``(campaign_id, condition_id, repetition, <metric name>, value)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import NUMERICAL_FLOOR, portable_uniform, safe_ratio, unpivot
from ..functions.student import t_p_value, t_quantile
from .design import CONTROLS, comparisons, factorial_cells
from .grouped import grouped_stats
from .runs import COUNTED_METRICS, mean_interval, summarize_long
from .signflip import signflip_mean  # noqa: F401


def standardized_effect(mean: Column, sd: Column) -> Column:
    """Mean over SD; null when the SD is missing or zero."""
    return F.when(sd > NUMERICAL_FLOOR, mean / sd)


def paired_t(n: Column, mean: Column, sd: Column) -> dict[str, Column]:
    """One-sample t statistic of paired differences, with its degrees of freedom."""
    usable = (n >= 2) & (sd > NUMERICAL_FLOOR)
    return {"t_statistic": F.when(usable, mean / (sd / F.sqrt(n))), "df": F.when(usable, n - 1)}


def with_tests(grouped: DataFrame) -> DataFrame:
    """Add dz, t, df and the two-sided p to a table that has n, mean and sd."""
    n, mean, sd = F.col("n"), F.col("mean"), F.col("sd")
    out = grouped.withColumns({"dz": standardized_effect(mean, sd), **paired_t(n, mean, sd)})
    return out.withColumn("raw_p", t_p_value(F.col("t_statistic"), F.col("df").cast("double")))


def holm(tests: DataFrame, family: Sequence[str], p: str, tie: str, out: str = "holm_p") -> DataFrame:
    """Step-down adjustment inside each family. Null p-values stay null and do not count.

    A family is a declared set of tests (at most a few dozen), so its window is small.
    """
    fam = Window.partitionBy(*family, F.col(p).isNull())
    order = fam.orderBy(p, tie)
    m, rank = F.count(p).over(fam), F.row_number().over(order)
    step = F.least(F.lit(1.0), (m - rank + 1) * F.col(p))
    running = F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return tests.withColumn("_step", step).withColumn(out, F.when(F.col(p).isNotNull(), running)).drop("_step")


def matched_pairs(runs: DataFrame) -> DataFrame:
    """Condition runs beside their control run of the same repetition, for each comparison.

    Both sides are unique on (campaign, condition, repetition), so the join never multiplies rows.
    """
    spec = comparisons(runs.sparkSession)
    keys = ["campaign_id", "condition_id", "repetition"]
    used = sorted({v for row in spec_metrics() for v in row})
    long = unpivot(runs, keys, used, "metric")
    wide = long.select(*keys, "metric", "value")
    treated = wide.join(F.broadcast(spec), F.col("condition_id") == F.col("condition")).select(
        "campaign_id", "repetition", "mechanism", "condition", "control", "primary_metric", "direct_metric", "metric",
        F.col("value").alias("y"),
    ).where("metric = primary_metric")
    control = wide.select("campaign_id", "repetition", F.col("condition_id").alias("control"), "metric", F.col("value").alias("x"))
    return treated.join(control, ["campaign_id", "repetition", "control", "metric"]).withColumns({
        "delta": F.col("y") - F.col("x"), "ratio": safe_ratio(F.col("y"), F.col("x")),
    })


def spec_metrics() -> list[tuple[str, str]]:
    from .design import COMPARISONS

    return [(c[3], c[4]) for c in COMPARISONS]


def isolated_effects(runs: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Paired effect of each mechanism on its primary metric, with direct evidence and Holm p."""
    pairs = matched_pairs(runs)
    keys = ["campaign_id", "mechanism", "condition", "control", "primary_metric", "direct_metric"]
    effects = grouped_stats(
        pairs, keys,
        [F.count("delta").alias("n"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"),
         F.min("ratio").alias("matched_ratio_min"), F.max("ratio").alias("matched_ratio_max")],
        {"ratio": {"matched_ratio_median": 0.5}}, hot_rows,
    )
    low, high = mean_interval(F.col("n"), F.col("mean"), F.col("sd"))
    effects = with_tests(effects.withColumns({"ci_low": low, "ci_high": high}))
    direct = unpivot(runs, ["campaign_id", "condition_id", "repetition"], sorted({d for _, d in spec_metrics()}), "direct_metric")
    evidence = grouped_stats(direct, ["campaign_id", "condition_id", "direct_metric"], (), {"value": {"_median": 0.5}}, hot_rows)
    side = lambda role, name: evidence.select("campaign_id", F.col("condition_id").alias(role), "direct_metric", F.col("_median").alias(name))
    out = effects.join(side("condition", "direct_evidence_median"), ["campaign_id", "condition", "direct_metric"], "left").join(
        side("control", "control_direct_evidence_median"), ["campaign_id", "control", "direct_metric"], "left")
    return holm(out, ["campaign_id"], "raw_p", "mechanism")


def factorial_cells_wide(long: DataFrame, name: str = "metric", keys: Sequence[str] = ("campaign_id",)) -> DataFrame:
    """The four cells of every design side by side, matched on repetition; incomplete sets drop out."""
    cells = factorial_cells(long.sparkSession)
    placed = long.join(F.broadcast(cells), "condition_id")
    pick = lambda cell: F.max(F.when(F.col("cell") == cell, F.col("value"))).alias(cell.lower())
    wide = placed.groupBy(*keys, "compound", name, "repetition").agg(*[pick(c) for c in ("A0B0", "A1B0", "A0B1", "A1B1")])
    return wide.where("a0b0 is not null and a1b0 is not null and a0b1 is not null and a1b1 is not null")


def factorial_marginals(runs: DataFrame, metrics: Sequence[str] = tuple(COUNTED_METRICS)) -> DataFrame:
    long = unpivot(runs, ["campaign_id", "condition_id", "repetition"], list(metrics), "metric")
    c = F.col
    return factorial_cells_wide(long).withColumns({
        "effect_a_when_b0": c("a1b0") - c("a0b0"), "effect_a_when_b1": c("a1b1") - c("a0b1"),
        "effect_b_when_a0": c("a0b1") - c("a0b0"), "effect_b_when_a1": c("a1b1") - c("a1b0"),
        "interaction_delta": c("a1b1") - c("a1b0") - c("a0b1") + c("a0b0"),
    })


def additivity_class(low: Column, high: Column) -> Column:
    return (
        F.when(low > 0, "SUPER_ADDITIVE_EVIDENCE").when(high < 0, "SUB_ADDITIVE_EVIDENCE").otherwise("INTERACTION_UNCERTAIN")
    )


def factorial_interactions(runs: DataFrame, metrics: Sequence[str] = tuple(COUNTED_METRICS)) -> DataFrame:
    marginals = factorial_marginals(runs, metrics)
    out = summarize_long(marginals, ["campaign_id", "compound", "metric"], "interaction_delta", medians=False)
    out = with_tests(out).withColumn("test_id", F.concat_ws(":", "compound", "metric"))
    out = out.withColumn("classification", additivity_class(F.col("ci_low"), F.col("ci_high")))
    return holm(out, ["campaign_id"], "raw_p", "test_id")


def significance_audit(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old and new adjusted p and class per test: did a decision at 5 % flip, did the class change."""
    o = old.select(*keys, F.col("holm_p").alias("old_holm_p"), F.col("classification").alias("old_class"))
    n = new.select(*keys, F.col("holm_p").alias("new_holm_p"), F.col("classification").alias("new_class"))
    flip = (F.col("old_holm_p") < 0.05) != (F.col("new_holm_p") < 0.05)
    changed = F.col("old_class") != F.col("new_class")
    return n.join(o, list(keys), "left").withColumns({
        "significance_changed": F.coalesce(flip, F.lit(False)).cast("int"),
        "classification_changed": F.coalesce(changed, F.lit(False)).cast("int"),
    })


def prediction_limit(n: Column, mean: Column, sd: Column, direction: str = "upper") -> Column:
    """One-sided 95 % limit for a single new value; null below two values."""
    if direction not in ("upper", "lower"):
        raise ValueError("direction must be upper or lower")
    margin = t_quantile(0.95, n - 1) * sd * F.sqrt(1 + 1 / n)
    return F.when(n >= 2, mean + margin if direction == "upper" else mean - margin)


# The control families that calibrate each service level.
CALIBRATION = [
    ("TTFT_SLO", "ttft_p95", "BASELINE"), ("TTFT_SLO", "ttft_p95", "OUTPUT_CONTROL"),
    ("TOTAL_LATENCY_SLO", "total_latency_p95", "BASELINE"), ("TOTAL_LATENCY_SLO", "total_latency_p95", "OUTPUT_CONTROL"),
    ("DECODE_DURATION_SLO", "post_first_token_duration_p95", "OUTPUT_CONTROL"),
]
CALIBRATION_RUNS = 8


def family_limits(runs: DataFrame, direction: str = "upper") -> DataFrame:
    """Prediction limit per service level and control family over valid control runs."""
    spec = runs.sparkSession.createDataFrame(CALIBRATION, "slo string, metric string, condition_id string")
    long = unpivot(runs.where(F.col("condition_id").isin(*CONTROLS)), ["campaign_id", "condition_id", "repetition"], COUNTED_METRICS, "metric")
    stats = long.join(F.broadcast(spec), ["metric", "condition_id"]).groupBy("campaign_id", "slo", "metric", "condition_id").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return stats.withColumn("threshold", prediction_limit(F.col("n"), F.col("mean"), F.col("sd"), direction))


def slo_calibration(runs: DataFrame, needed: int = CALIBRATION_RUNS) -> DataFrame:
    """Final limit per service level: the largest family limit, the family that set it (ties to the
    first family by name), and whether every family had enough runs."""
    fam = family_limits(runs)
    # The first family in name order wins ties, so order by threshold and then backwards by name.
    rank = F.struct(F.col("threshold"), (F.col("condition_id") == "BASELINE").cast("int"))
    return fam.groupBy("campaign_id", "slo", "metric").agg(
        F.max("threshold").alias("final_threshold"), F.max_by("condition_id", rank).alias("selected_family"),
        F.bool_and(F.col("n") >= needed).cast("int").alias("enough_runs"),
    )


def calibration_sanity(runs: DataFrame) -> DataFrame:
    """Control runs against their campaign's final limits; decode counts for one family only."""
    limits = slo_calibration(runs).groupBy("campaign_id").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("final_threshold"))).alias(f"_{m}") for m in COUNTED_METRICS])
    controls = runs.where(F.col("condition_id").isin(*CONTROLS)).join(limits, "campaign_id")
    over = lambda m: F.coalesce(F.col(m) > F.col(f"_{m}"), F.lit(False))
    return controls.select(
        "campaign_id", "run_id", "condition_id", over("ttft_p95").cast("int").alias("ttft_crossed"),
        over("total_latency_p95").cast("int").alias("total_latency_crossed"),
        (over("post_first_token_duration_p95") & (F.col("condition_id") == "OUTPUT_CONTROL")).cast("int").alias("decode_crossed"),
    )


def precision_plan(long: DataFrame, keys: Sequence[str], candidates: Sequence[int] = (5, 6, 8, 10)) -> DataFrame:
    """Relative half width at candidate sample sizes, by the one-sided 5 % quantile as recorded."""
    stats = long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    grid = stats.withColumn("candidate_n", F.explode(F.array(*[F.lit(c) for c in candidates])))
    width = F.abs(t_quantile(0.95, F.col("candidate_n") - 1) * F.col("sd") / F.sqrt("candidate_n") / F.nullif(F.col("mean"), F.lit(0.0)))
    return grid.withColumn("relative_half_width", F.when(F.col("n") >= 2, width)).drop("n", "mean", "sd")


def welch(n1: Column, m1: Column, s1: Column, n2: Column, m2: Column, s2: Column) -> dict[str, Column]:
    a, b = s1 * s1 / n1, s2 * s2 / n2
    usable = (n1 > 1) & (n2 > 1) & (a + b > 0)
    return {
        "welch_t": F.when(usable, (m1 - m2) / F.sqrt(a + b)),
        "welch_df": F.when(usable, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1))),
    }


def control_transportability(origins: DataFrame, keys: Sequence[str], first: str = "calibration", second: str = "formal") -> DataFrame:
    """Shift of control metrics between two origins, tagged in ``origin``: one conditional aggregate."""
    long = unpivot(origins.where(F.col("condition_id").isin(*CONTROLS)), [*keys, "origin", "condition_id", "repetition"], COUNTED_METRICS, "metric")
    aggs = []
    for o in (first, second):
        v = F.when(F.col("origin") == o, F.col("value"))
        aggs += [F.count(v).alias(f"{o}_n"), F.avg(v).alias(f"{o}_mean"), F.stddev_samp(v).alias(f"{o}_sd"),
                 F.min(v).alias(f"{o}_min"), F.max(v).alias(f"{o}_max")]
    out = long.groupBy(*keys, "condition_id", "metric").agg(*aggs)
    shift = F.col(f"{second}_mean") - F.col(f"{first}_mean")
    out = out.withColumns({
        "absolute_shift": shift, "percent_shift": safe_ratio(shift, F.col(f"{first}_mean")) * 100.0,
        **welch(*[F.col(f"{second}_{s}") for s in ("n", "mean", "sd")], *[F.col(f"{first}_{s}") for s in ("n", "mean", "sd")]),
    })
    return out.withColumn("welch_p", t_p_value(F.col("welch_t"), F.col("welch_df")))


def feature_shift(long: DataFrame, keys: Sequence[str], by_condition: bool = False, hot_rows: int | None = None) -> DataFrame:
    """Source against target statistics per feature (rows tagged by ``domain``), optionally per condition.

    SD is zero for fewer than two values; the standardised shift uses the source SD.
    """
    group = [*keys, "feature", *(["condition_id"] if by_condition else [])]
    tagged = long.withColumns({d: F.when(F.col("domain") == d, F.col("value")) for d in ("source", "target")})
    aggs = []
    for d in ("source", "target"):
        aggs += [F.avg(d).alias(f"{d}_mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias(f"{d}_sd"),
                 F.min(d).alias(f"{d}_min"), F.max(d).alias(f"{d}_max")]
    out = grouped_stats(tagged, group, aggs, {d: {f"{d}_median": 0.5} for d in ("source", "target")}, hot_rows)
    c = F.col
    inter = F.greatest(F.lit(0.0), F.least("source_max", "target_max") - F.greatest("source_min", "target_min"))
    union = F.greatest("source_max", "target_max") - F.least("source_min", "target_min")
    both = c("source_min").isNotNull() & c("target_min").isNotNull()
    gap = F.coalesce(c("target_mean"), F.lit(0.0)) - F.coalesce(c("source_mean"), F.lit(0.0))
    return out.withColumns({
        "standardized_mean_shift": F.when(c("source_sd") > 0, gap / c("source_sd")),
        "range_overlap": F.when(both, F.when(union > 0, inter / union).otherwise(1.0)),
    })


def bootstrap_draws(groups: DataFrame, keys: Sequence[str], resamples: int, seed: int) -> DataFrame:
    """How often each of ``n`` items is drawn in each resample, from a portable hash.

    ``groups`` has one row per group with ``n``. The draws are counted per (resample, item) on the
    map side before any join.
    """
    slots = groups.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn(
        "slot", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    drawn = F.floor(portable_uniform(seed, *[F.col(k) for k in keys], F.col("b"), F.col("slot")) * F.col("n")).cast("int") + 1
    return slots.select(*keys, "n", "b", drawn.alias("item")).groupBy(*keys, "n", "b", "item").agg(F.count(F.lit(1)).alias("weight"))


def result_table(summary: DataFrame, frequency: DataFrame, metrics: Sequence[str] = tuple(COUNTED_METRICS)) -> DataFrame:
    """Printed condition table: one interval text per counted metric, and counts as k of n.

    ``summary`` and ``frequency`` are the long condition summary and violation table.
    """
    from .derive import interval_text

    keys = ["campaign_id", "condition_id"]
    text = interval_text(F.col("mean"), F.col("ci_low"), F.col("ci_high"))
    left = summary.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, text)).alias(f"{m}_text") for m in metrics])
    share = F.concat_ws("/", F.col("count").cast("string"), F.col("n").cast("string"))
    names = ["ttft_violations", "total_latency_violations", "decode_duration_violations", "compound_slo_runs"]
    right = frequency.groupBy(*keys).agg(*[F.max(F.when(F.col("count_name") == c, share)).alias(c) for c in names])
    return left.join(right, keys)
