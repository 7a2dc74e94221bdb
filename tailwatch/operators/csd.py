"""Compound-signature divergence: how far a pair of faults departs from additivity over features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from . import signflip
from .design import factorial_cells
from .grouped import grouped_stats, hot_groups, sized_broadcast
from .inference import bootstrap_draws, factorial_cells_wide, holm

SCALE_FLOOR = 1e-12
MAD_FACTOR = 1.4826
#: Mean residuals up to this count as none: sums that cancel leave a rest whose sign depends on their order.
DIRECTION_FLOOR = 1e-9
KEYS = ["campaign_id", "compound"]
#: Most repetitions of a group whose resamples are drawn in one task.
MOST_DRAWN = 64
#: Most values of a cell that are gathered into one array.
MOST_GATHERED = 50_000

# Features of the divergence vector and of its extended view.
PRIMARY_FEATURES = [
    "ttft_p95", "total_latency_p95", "post_first_token_duration_p95", "ttft_median", "total_latency_median",
    "post_first_token_duration_median", "scheduler_slip_p95", "successful_requests_per_second",
]
EXTENDED_FEATURES = [
    "host_cpu_median", "host_cpu_p95", "dependency_duration_median", "dependency_duration_p95",
    "server_prompt_tokens_median", "server_output_tokens_median",
]


def _placed(long: DataFrame) -> DataFrame:
    return long.where("value is not null").join(F.broadcast(factorial_cells(long.sparkSession)), "condition_id")


def pooled_sd(long: DataFrame) -> DataFrame:
    """Within-cell SD pooled over the four cells by degrees of freedom; zero when no cell has two runs."""
    cell = _placed(long).groupBy(*KEYS, "feature", "cell").agg(F.count("value").alias("n"), F.var_samp("value").alias("v"))
    return cell.groupBy(*KEYS, "feature").agg(_sd_scale().alias("scale"))


def pooled_mad(long: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Scaled median absolute deviation per cell, pooled as the root of the n-weighted mean square."""
    return _cells(long, hot_rows).groupBy(*KEYS, "feature").agg(_mad_scale().alias("scale"))


def pooled_scales(long: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``pooled_sd`` and ``pooled_mad`` side by side, from one pass over the cells."""
    return _cells(long, hot_rows).groupBy(*KEYS, "feature").agg(_sd_scale().alias("sd_scale"), _mad_scale().alias("mad_scale"))


def _sd_scale() -> Column:
    good = F.col("n") >= 2
    ss = F.sum(F.when(good, (F.col("n") - 1) * F.col("v")))
    return F.coalesce(F.sqrt(ss / F.sum(F.when(good, F.col("n") - 1))), F.lit(0.0))


def _mad_scale() -> Column:
    square = F.pow(F.lit(MAD_FACTOR) * F.col("mad"), 2)
    return F.sqrt(F.sum(F.col("n") * square) / F.sum("n"))


def _middle(values: str) -> Column:
    """Median of an ordered array."""
    at = (F.size(values) - 1) / 2
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return F.when(at == F.floor(at), low).otherwise(0.5 * low + 0.5 * high)


def _cells(long: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Number, variance and median absolute deviation of each cell's values, n, v and mad.

    A cell of up to ``MOST_GATHERED`` values is one array; larger ones take the route of exact percentiles over all tasks.
    """
    keys = [*KEYS, "feature", "cell"]
    placed = _placed(long)
    moments = [F.count("value").alias("n"), F.var_samp("value").alias("v")]
    # a cell holds runs of one campaign only
    hot, n_hot = hot_groups(placed, keys, MOST_GATHERED if hot_rows is None else hot_rows, long.select("campaign_id", "feature"))

    def gathered(rows):
        held = rows.groupBy(*keys).agg(*moments, F.array_sort(F.collect_list("value")).alias("_v")).withColumn("_c", _middle("_v"))
        away = held.withColumn("_d", F.array_sort(F.transform("_v", lambda x: F.abs(x - F.col("_c")))))
        return away.select(*keys, "n", "v", _middle("_d").alias("mad"))

    if not n_hot:
        return gathered(placed)
    hot = sized_broadcast(hot, n_hot)
    large = placed.join(hot, keys, "left_semi")
    centre = grouped_stats(large, keys, (), {"value": {"centre": 0.5}}, hot_rows)
    spread = large.join(centre, keys).withColumn("_d", F.abs(F.col("value") - F.col("centre")))
    return gathered(placed.join(hot, keys, "left_anti")).unionByName(grouped_stats(spread, keys, moments, {"_d": {"mad": 0.5}}, hot_rows))


def residuals(long: DataFrame, scale_kind: str = "sd", hot_rows: int | None = None) -> DataFrame:
    """Cells, additive prediction and (standardised) interaction residual per feature and repetition."""
    scale = pooled_sd(long) if scale_kind == "sd" else pooled_mad(long, hot_rows)
    wide = factorial_cells_wide(long, "feature")
    c = F.col
    usable = scale.where((c("scale") > SCALE_FLOOR) & ~F.isnan("scale"))
    out = wide.join(usable, [*KEYS, "feature"]).withColumns({
        "predicted": c("a1b0") + c("a0b1") - c("a0b0"), "delta": c("a1b1") - c("a1b0") - c("a0b1") + c("a0b0"),
    })
    return out.withColumn("z", c("delta") / c("scale"))


def feature_means(res: DataFrame) -> DataFrame:
    """Means over repetitions per (compound, feature): the table everything below starts from."""
    return res.groupBy(*KEYS, "feature").agg(
        F.avg("a0b0").alias("control_mean"), F.avg("a1b0").alias("a_only_mean"), F.avg("a0b1").alias("b_only_mean"),
        F.avg("a1b1").alias("observed_mean"), F.avg("predicted").alias("predicted_mean"),
        F.avg("delta").alias("raw_residual"), F.avg("z").alias("zbar"), F.first("scale").alias("scale"),
    )


def csd(means: DataFrame) -> DataFrame:
    return means.groupBy(*KEYS).agg(F.sqrt(F.avg(F.pow("zbar", 2))).alias("csd"), F.count(F.lit(1)).alias("feature_count"))


def repetition_csd(res: DataFrame) -> DataFrame:
    return res.groupBy(*KEYS, "repetition").agg(F.sqrt(F.avg(F.pow("z", 2))).alias("csd_r"))


def _with_totals(means: DataFrame) -> DataFrame:
    # Features of a compound are a declared list, so this window is a few dozen rows.
    w = Window.partitionBy(*KEYS)
    return means.withColumns({"_s": F.sum(F.pow("zbar", 2)).over(w), "_k": F.count(F.lit(1)).over(w)})


def contributions(means: DataFrame) -> DataFrame:
    """Share of each feature in the squared divergence, with direction; all zero when there is none."""
    share = F.when(F.col("_s") > 0, F.pow("zbar", 2) / F.col("_s")).otherwise(0.0)
    direction = F.when(F.col("zbar") > DIRECTION_FLOOR, "positive").when(F.col("zbar") < -DIRECTION_FLOOR, "negative").otherwise("zero")
    return _with_totals(means).withColumns({"contribution_fraction": share, "interaction_direction": direction}).drop("_s", "_k")


def signature(means: DataFrame) -> DataFrame:
    return contributions(means)


def leave_one_out(means: DataFrame) -> DataFrame:
    """Divergence without each feature, from totals: no loop over features."""
    rest = F.greatest(F.lit(0.0), F.col("_s") - F.pow("zbar", 2))
    out = _with_totals(means).withColumns({
        "csd": F.sqrt(F.col("_s") / F.col("_k")),
        "csd_without_feature": F.when(F.col("_k") > 1, F.sqrt(rest / (F.col("_k") - 1))),
    })
    return out.withColumn("absolute_change", F.abs(F.col("csd_without_feature") - F.col("csd"))).drop("_s", "_k")


def signflip_vector(res: DataFrame, draws: int | None = None) -> DataFrame:
    """Sign-flip test of the whole residual vector: one sign per repetition for all its features."""
    return signflip.signflip_vector(res, KEYS, csd(feature_means(res)), draws=draws)


def _drawn_interval(z: np.ndarray, prefix: bytes, slots: list[bytes], resamples: int) -> tuple[float | None, float | None]:
    """Interval of one group: ``z`` has a row a repetition and a column a feature, NaN where a repetition lacks one."""
    n = len(z)
    drawn = np.array([int.from_bytes(md5(prefix + s).digest()[:4], "big") for s in slots])
    items = np.floor(drawn / 4294967296.0 * n).astype(int).reshape(resamples, n)
    weights = np.zeros((resamples, n))
    np.add.at(weights, (np.arange(resamples)[:, None], items), 1.0)
    present = ~np.isnan(z)
    some = weights @ present > 0
    squares = np.where(some, (weights @ np.where(present, z, 0.0) / n) ** 2, 0.0)
    features = some.sum(axis=1)
    stats = np.sqrt(squares.sum(axis=1)[features > 0] / features[features > 0])
    return tuple(float(v) for v in np.quantile(stats, (0.025, 0.975))) if len(stats) else (None, None)


def _small_intervals(res: DataFrame, reps: DataFrame, resamples: int, seed: int) -> DataFrame:
    """Intervals of groups of at most ``MOST_DRAWN`` repetitions, a row of values each: no draw leaves its task."""
    rows = res.join(reps, [*KEYS, "repetition"]).groupBy(*KEYS, "n").agg(F.collect_list(F.struct("item", "feature", "z")).alias("cells"))

    def intervals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots: dict[int, list[bytes]] = {}
        for frame in frames:
            found = []
            for row in frame.itertuples():
                names = sorted({c["feature"] for c in row.cells})
                z = np.full((row.n, len(names)), np.nan)
                for c in row.cells:
                    z[c["item"] - 1, names.index(c["feature"])] = c["z"]
                if row.n not in slots:
                    slots[row.n] = [f"{b}|{s}".encode() for b in range(1, resamples + 1) for s in range(1, row.n + 1)]
                found.append(_drawn_interval(z, "|".join([str(seed), *[str(getattr(row, k)) for k in KEYS], ""]).encode(), slots[row.n], resamples))
            yield frame[KEYS].assign(bootstrap_low=[f[0] for f in found], bootstrap_high=[f[1] for f in found])

    keys = ", ".join(f"{k} {t}" for k, t in res.select(*KEYS).dtypes)
    # one group is some tenth of a second of draws, so groups spread by their number and not by their bytes
    spread = rows.repartition(max(1, int(res.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *KEYS)
    return spread.mapInPandas(intervals, f"{keys}, bootstrap_low double, bootstrap_high double")


def bootstrap_interval(res: DataFrame, resamples: int = 10000, seed: int = 7101, hot_rows: int | None = None, most: int = MOST_DRAWN) -> DataFrame:
    """Percentile interval of the divergence under resampled repetitions."""
    from .ordered import with_rank

    reps = pin(with_rank(res.select(*KEYS, "repetition").distinct(), KEYS, ["repetition"], "item", "n"))
    small = _small_intervals(res.select(*KEYS, "repetition", "feature", "z"), reps.where(F.col("n") <= most), resamples, seed)
    large = reps.where(F.col("n") > most)
    if large.isEmpty():
        return small
    draws = bootstrap_draws(large.select(*KEYS, "n").distinct(), KEYS, resamples, seed)
    z = res.select(*KEYS, "repetition", "feature", "z").join(large.select(*KEYS, "repetition", "item"), [*KEYS, "repetition"])
    means = draws.join(z, [*KEYS, "item"]).groupBy(*KEYS, "b", "feature").agg((F.sum(F.col("weight") * F.col("z")) / F.first("n")).alias("m"))
    stats = means.groupBy(*KEYS, "b").agg(F.sqrt(F.avg(F.pow("m", 2))).alias("stat"))
    return small.unionByName(grouped_stats(stats, KEYS, (), {"stat": {"bootstrap_low": 0.025, "bootstrap_high": 0.975}}, hot_rows))


def summary(res: DataFrame, robust: DataFrame, extended: DataFrame, runs: DataFrame, resamples: int = 10000, seed: int = 7101) -> DataFrame:
    """One row per compound: divergence, test, interval, sensitivities, leading feature, violations."""
    means = feature_means(res)
    contrib = contributions(means).groupBy(*KEYS).agg(
        F.max_by("feature", F.struct("contribution_fraction", "feature")).alias("largest_contribution_feature"),
        F.max("contribution_fraction").alias("largest_contribution_fraction"), F.count(F.lit(1)).alias("feature_count"))
    loo = leave_one_out(means).groupBy(*KEYS).agg(
        F.min("csd_without_feature").alias("loo_csd_min"), F.max("csd_without_feature").alias("loo_csd_max"))
    tested = holm(signflip_vector(res).drop("method"), ["campaign_id"], "exact_p", "compound")
    violations = runs.groupBy("campaign_id", F.col("condition_id").alias("compound")).agg(
        F.count_if(F.col("slo_violation_class") == "COMPOUND_SLO_VIOLATION").alias("compound_slo_runs"), F.count(F.lit(1)).alias("runs"))
    out = tested.join(contrib, KEYS).join(loo, KEYS).join(bootstrap_interval(res, resamples, seed), KEYS)
    out = out.join(csd(feature_means(robust)).select(*KEYS, F.col("csd").alias("robust_scale_csd")), KEYS, "left")
    out = out.join(csd(feature_means(extended)).select(*KEYS, F.col("csd").alias("extended_csd")), KEYS, "left").join(violations, KEYS, "left")
    return out.withColumn("statistically_supported", (F.col("holm_p") < 0.05).cast("int"))


def sign_gate(means: DataFrame, interactions: DataFrame) -> DataFrame:
    """Whether each residual has the sign of the separately computed interaction mean."""
    other = interactions.select(*KEYS, F.col("metric").alias("feature"), F.col("mean").alias("interaction_mean"))
    return means.join(other, [*KEYS, "feature"]).withColumn(
        "sign_matches", (F.signum("raw_residual") == F.signum("interaction_mean")).cast("int"))


def registry_missingness(long: DataFrame, keys: Sequence[str] = ("campaign_id",)) -> DataFrame:
    """Null count and availability per feature; ``included`` when nothing is missing."""
    out = long.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("present"))
    return out.withColumns({
        "missing": F.col("rows") - F.col("present"), "availability": F.col("present") / F.col("rows"),
        "included": (F.col("present") == F.col("rows")).cast("int"),
    })
