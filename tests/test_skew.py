"""The routes for hot groups give the same answers as the ordinary ones and as brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailwatch.operators.grouped import grouped_stats
from tailwatch.operators.ordered import with_lag, with_neighbours, with_rank, with_running_sum


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", i, float(rng.normal()), float(rng.integers(0, 4))) for i in range(4000)]
    rows += [(f"g{i % 7}", i, float(rng.normal()), None if i % 3 else 1.5) for i in range(300)]
    rows += [("blank", i, None, None) for i in range(400)]
    return spark.createDataFrame(rows, "g string, i long, x double, y double").cache()


def as_map(df, key="g"):
    return {tuple(r[k] for k in key.split()): r for r in df.collect()}


def test_hot_percentiles_are_exact(skewed):
    want = {"x": {"x05": 0.05, "x50": 0.5, "x95": 0.95, "x0": 0.0, "x1": 1.0}, "y": {"y50": 0.5, "y95": 0.95}}
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("x").alias("m")]
    plain = as_map(grouped_stats(skewed, ["g"], aggs, want))
    hot = as_map(grouped_stats(skewed, ["g"], aggs, want, hot_rows=200))
    assert plain.keys() == hot.keys()
    rows = skewed.toPandas()
    for (g,), r in hot.items():
        for name, value in r.asDict().items():
            other = plain[(g,)][name]
            assert (value is None) == (other is None)
            if isinstance(value, float):
                assert value == pytest.approx(other, abs=1e-12)
        x = rows[rows.g == g].x.dropna()
        if len(x):
            assert r["x95"] == pytest.approx(np.percentile(x, 95), abs=1e-12)


def test_hot_percentiles_with_few_distinct_values(spark):
    df = spark.range(5000).select(F.lit("a").alias("g"), (F.col("id") % 3).cast("double").alias("v"))
    r = grouped_stats(df, ["g"], (), {"v": {"a": 0.1, "b": 0.5, "c": 0.99}}, hot_rows=10).collect()[0]
    assert (r.a, r.b, r.c) == (0.0, 1.0, 2.0)


def test_hot_rank_lag_sum_and_neighbours(skewed):
    rows = skewed.withColumn("step", F.when(F.col("i") % 2 == 0, 1).otherwise(-1))
    ops = {
        "rank": lambda h: with_rank(rows, ["g"], ["i"], "out", "n", hot_rows=h),
        "lag": lambda h: with_lag(rows, ["g"], ["i"], {"out": "x"}, 3, hot_rows=h),
        "sum": lambda h: with_running_sum(rows, ["g"], ["i"], "step", "out", hot_rows=h),
        "near": lambda h: with_neighbours(rows, ["g"], ["i"], F.col("i") % 97 == 5, ["i", "x"], "out", "after", hot_rows=h),
    }
    for name, op in ops.items():
        plain = {(r.g, r.i): r for r in op(None).collect()}
        hot = {(r.g, r.i): r for r in op(200).collect()}
        assert plain.keys() == hot.keys(), name
        for k, r in hot.items():
            assert r.out == plain[k].out, (name, k)
            if name == "near":
                assert r.after == plain[k].after
            if name == "rank":
                assert r.n == plain[k].n


def test_nearest_neighbour_equals_brute_force(spark):
    from tailwatch.operators import diagnose as G
    from tailwatch.operators.design import CAUSES

    rng = np.random.default_rng(5)
    sets = ["NONE", "INPUT", "LOAD", "INPUT+LOAD"]
    rows = []
    for i in range(240):
        s = sets[i % 4]
        x = [float(v) for v in rng.normal(loc=3 * (i % 4), size=3)]
        rows.append((0, "c", 1, f"r{i:03d}", 1, "test" if i % 5 == 0 else "train", 1, s, 0, 0, 0, 0, x))
    cols = "campaign_id long, condition_id string, repetition int, run_id string, fold int, role string, degree int, truth_set string, " + ", ".join(f"label_{c} int" for c in CAUSES) + ", x array<double>"
    got = {r.run_id: r for r in G.nearest_neighbour(spark.createDataFrame(rows, cols), ["campaign_id", "fold"], 3).collect()}
    train = [r for r in rows if r[5] == "train"]
    for r in rows:
        if r[5] == "test":
            best = min(train, key=lambda t: (float(np.linalg.norm(np.array(t[-1]) - np.array(r[-1]))), t[3]))
            assert got[r[3]].neighbour_id == best[3]
            assert -got[r[3]].score == pytest.approx(np.linalg.norm(np.array(best[-1]) - np.array(r[-1])))


def test_pareto_matches_pairwise_rule(spark):
    from tailwatch.operators.cost import pareto

    rng = np.random.default_rng(9)
    pts = [("a", i, float(rng.integers(0, 6)), float(rng.integers(0, 6)), float(rng.integers(0, 6))) for i in range(120)]
    df = spark.createDataFrame(pts, "g string, i long, q double, a double, b double")
    for r in pareto(df, ["g"], "q", ("a", "b")).collect():
        beaten = any(p[2] >= r.q and p[3] <= r.a and p[4] <= r.b and (p[2] > r.q or p[3] < r.a or p[4] < r.b) for p in pts)
        assert r.pareto_dominated == int(beaten)
