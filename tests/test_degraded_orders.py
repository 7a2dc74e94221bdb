"""Order features under many masks in one pass, against one mask at a time and against plain Python."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tailwatch.operators import degrade as R
from tailwatch.operators import temporal as T

METRICS = ["ttft", "total_latency"]
SCHEMA = "campaign_id long, run_id string, ordinal long, ttft double, total_latency double"


def rows(seed=3, runs=4):
    rng = random.Random(seed)
    return [(i % 2, f"r{i}", o, None if rng.random() < 0.2 else rng.uniform(0, 5), rng.uniform(1, 2)) for i in range(runs) for o in range(3 + 9 * i)]


def slope(values):
    alive = [v for v in values if v is not None]
    if len(alive) < 2:
        return None
    xs = [i / (len(alive) - 1) for i in range(len(alive))]
    mx, my = sum(xs) / len(xs), sum(alive) / len(alive)
    return sum((x - mx) * (y - my) for x, y in zip(xs, alive, strict=True)) / sum((x - mx) ** 2 for x in xs)


def plain(values):
    """Early and late medians of a quarter and the slope over values that are there; all null when two quarters do not fit."""
    n, q = len(values), max(3, len(values) // 4)
    if n < 2 * q:
        return None, None, None, None
    mid = lambda part: median(p) if (p := [v for v in part if v is not None]) else None
    early, late = mid(values[:q]), mid(values[n - q:])
    return early, late, None if early is None or late is None else late - early, slope(values)


def stats(df, keys):
    return {tuple(r[k] for k in [*keys, "metric"]): tuple(r[c] for c in ("early_median", "late_median", "late_minus_early", "normalized_slope")) for r in df.collect()}


def close(got, want):
    assert set(got) == set(want)
    for k, w in want.items():
        assert [x is None for x in got[k]] == [x is None for x in w], k
        assert [x for x in got[k] if x is not None] == pytest.approx([x for x in w if x is not None], abs=1e-9), k


@pytest.mark.parametrize("hot_rows", [None, 5])
def test_one_ordering_serves_all_metrics(spark, hot_rows):
    data = rows()
    series = T.with_rank(spark.createDataFrame(data, SCHEMA), ["run_id"], ["ordinal"], "rn", "n")
    got = stats(T.order_features(series, ["run_id"], METRICS, hot_rows), ["run_id"])
    want = {}
    for run in {r[1] for r in data}:
        own = sorted(r[2:] for r in data if r[1] == run)
        for i, m in enumerate(METRICS):
            want[run, m] = plain([r[1 + i] for r in own])
    close(got, want)


def test_masks_in_one_pass_equal_single_masks(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    seeds = F.array(F.lit(8301), F.lit(8302))
    grid = T.order_features(T.sampled_grid(df.withColumns({"rn": F.lit(1), "n": F.lit(1)}), ["run_id"], R.SAMPLING_LEVELS, seeds), ["run_id", "seed", "severity"], METRICS)
    got = stats(grid, ["run_id", "seed", "severity"])
    want = {}
    for seed in (8301, 8302):
        for f in R.SAMPLING_LEVELS:
            one = T.subsampled(df, ["run_id"], f, seed)
            for (run, m), v in stats(T.quarter_features(T.melt(one, ["run_id"], ("rn", "n"), METRICS), ["run_id"]), ["run_id"]).items():
                want[run, seed, f, m] = v
    close(got, want)


def test_shifts_in_one_pass_equal_lists(spark):
    data = rows(5)
    series = T.with_rank(spark.createDataFrame(data, SCHEMA), ["run_id"], ["ordinal"], "rn", "n")
    got = stats(T.order_features(T.delayed_grid(series, R.DELAY_LEVELS), ["run_id", "severity"], METRICS), ["run_id", "severity"])
    want = {}
    for run in {r[1] for r in data}:
        own = sorted(r[2:] for r in data if r[1] == run)
        for d in R.DELAY_LEVELS:
            if d < len(own):
                for i, m in enumerate(METRICS):
                    want[run, float(d), m] = plain([None] * d + [r[1 + i] for r in own][:len(own) - d])
    close(got, want)


def test_pair_cases_take_the_worst_channel(spark):
    point = "family string, severity double, seed int, lost string"
    data = [("clean", None, None, None, 1), ("clean", None, None, None, 0), ("noise", 0.5, 1, None, 1), ("noise", 0.5, 2, None, 0), ("noise", 0.1, 1, None, 0),
            ("channel_loss", None, None, "A", 1), ("channel_loss", None, None, "B", 0), ("channel_loss", None, None, "B", 1), ("channel_loss", None, None, "B", 0)]
    df = spark.createDataFrame([(1, "C", 2, *d) for d in data], f"campaign_id int, condition_id string, true_degree int, {point}, correct int")
    r = R.pair_worst_cases(df, ["campaign_id"], ["family", "severity", "seed", "lost"], {"clean_exact": ("clean", None), "noise_50": ("noise", 0.5)}).collect()[0]
    assert (r.clean_exact, r.noise_50, r.worst_channel) == (0.5, 0.5, pytest.approx(1 / 3))
