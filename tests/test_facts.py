"""Known numbers on small hand-made tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailwatch.functions.student import t_p_value, t_quantile, t_two_sided
from tailwatch.operators import csd as C
from tailwatch.operators import degrade as R
from tailwatch.operators import derive as D
from tailwatch.operators import inference as I
from tailwatch.operators import temporal as T
from tailwatch.operators.grouped import grouped_stats


def test_percentile(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 0.0), ("b", 10.0)], "g string, v double")
    got = {r.g: r for r in grouped_stats(df, ["g"], (), {"v": {"m": 0.5, "p": 0.95}}).collect()}
    assert got["a"].m == 2.5 and got["b"].p == pytest.approx(9.5)


def test_t_tails():
    p = t_two_sided(np.array([3.872983346207417, 10.069756700139282]), np.array([3, 3]))
    assert p == pytest.approx([0.030466291662170977, 0.0020854803149752787], abs=1e-14)


def test_t_columns(spark):
    df = spark.createDataFrame([(3.872983346207417, 3.0, 7), (None, 3.0, 500)], "t double, df double, k int")
    a, b = df.select(t_p_value("t", "df").alias("p"), t_quantile(0.975, F.col("k")).alias("q")).collect()
    assert a.p == pytest.approx(0.030466291662170977) and b.p is None
    assert a.q == pytest.approx(2.364624251592785) and b.q == pytest.approx(1.964719837, abs=1e-7)


def test_dz_and_t(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "v double")
    g = df.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    r = I.with_tests(g).collect()[0]
    assert r.t_statistic == pytest.approx(3.872983346207417) and r.raw_p == pytest.approx(0.030466291662170977)
    d = spark.createDataFrame([(2.0,), (4.0,), (6.0,)], "v double").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    assert d.select(I.standardized_effect(F.col("m"), F.col("s"))).collect()[0][0] == 2.0


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.03), ("f", "c", 0.02), ("f", "d", None)], "fam string, t string, p double")
    got = {r.t: r.holm_p for r in I.holm(df, ["fam"], "p", "t").collect()}
    assert got["a"] == pytest.approx(0.03) and got["b"] == pytest.approx(0.04) and got["c"] == pytest.approx(0.04) and got["d"] is None


def test_holm_of_five(spark):
    df = spark.createDataFrame([("f", str(i), p) for i, p in enumerate((0.01, 0.02, 0.5, 0.04, 0.03))], "fam string, t string, p double")
    got = {r.t: r.holm_p for r in I.holm(df, ["fam"], "p", "t").collect()}
    assert got["0"] == pytest.approx(0.05) and got["1"] == pytest.approx(0.08) and got["4"] == pytest.approx(0.09)


def test_slo_flags(spark):
    lim = D.SLO_LIMITS
    df = spark.createDataFrame([(lim["ttft_p95"] + 1e-6, lim["total_latency_p95"] + 1e-6, lim["post_first_token_duration_p95"] - 1e-6), (None, 0.0, 0.0)],
                               "ttft_p95 double, total_latency_p95 double, post_first_token_duration_p95 double")
    a, b = D.with_slo_flags(df).collect()
    assert a.slo_violation_count == 2 and a.slo_violation_class == "COMPOUND_SLO_VIOLATION"
    assert b.slo_violation_count == 0


def test_sign_flips(spark):
    ones = spark.createDataFrame([("a", i, 1.0) for i in range(8)], "g string, r int, value double")
    r = I.signflip_mean(ones, ["g"], "r").collect()[0]
    assert r.signflip_p == 2 / 256


def residual_table(spark, values):
    rows = [(0, comp, f, rep, z) for comp, f, rep, z in values]
    return spark.createDataFrame(rows, "campaign_id long, compound string, feature string, repetition int, z double")


def test_csd_and_vector_flip(spark):
    res = residual_table(spark, [("X", "f", r, 3.0) for r in range(8)] + [("X", "g", r, 4.0) for r in range(8)])
    res = res.withColumns({c: F.lit(0.0) for c in ("a0b0", "a1b0", "a0b1", "a1b1", "predicted", "delta", "scale")})
    means = C.feature_means(res)
    assert C.csd(means).collect()[0].csd == pytest.approx(math.sqrt(12.5))
    assert sum(r.contribution_fraction for r in C.contributions(means).collect()) == pytest.approx(1.0)
    assert C.signflip_vector(res).collect()[0].exact_p == 2 / 256
    loo = {r.feature: r.csd_without_feature for r in C.leave_one_out(means).collect()}
    assert loo["f"] == pytest.approx(4.0) and loo["g"] == pytest.approx(3.0)


def test_pooled_scale(spark):
    rows = [(0, c, r, "f", v) for c, vs in (("BASELINE", (1.0, 2.0, 3.0)), ("INPUT_MEDIUM", (2.0, 3.0, 4.0))) for r, v in enumerate(vs)]
    long = spark.createDataFrame(rows, "campaign_id long, condition_id string, repetition int, feature string, value double")
    got = {r.compound: r.scale for r in C.pooled_sd(long).collect()}
    assert got["INPUT_LOAD"] == pytest.approx(1.0)


def test_factorial_interaction(spark):
    cells = {"BASELINE": 1.0, "INPUT_MEDIUM": 3.0, "LOAD_MEDIUM": 4.0, "INPUT_LOAD": 10.0}
    long = spark.createDataFrame([(0, c, 1, "m", v) for c, v in cells.items()], "campaign_id long, condition_id string, repetition int, metric string, value double")
    r = I.factorial_cells_wide(long).where("compound = 'INPUT_LOAD'").collect()[0]
    assert r.a1b1 - r.a1b0 - r.a0b1 + r.a0b0 == 4.0


def series(spark, values):
    return spark.createDataFrame([("r", "m", i + 1, len(values), v) for i, v in enumerate(values)], "run_id string, metric string, rn int, n int, value double")


def test_early_late_and_delay(spark):
    r = T.quarter_features(series(spark, [float(i) for i in range(12)]), ["run_id"]).collect()[0]
    assert r.late_minus_early == 9.0 and r.normalized_slope == pytest.approx(11.0)
    moved = T.delayed(series(spark, [float(i) for i in range(10)]), ["run_id"], 3).orderBy("rn").collect()
    assert moved[0].rn == 4 and moved[-1].value == 6.0


def test_noise_is_clipped_and_missing_stays(spark):
    df = spark.createDataFrame([("r", "ttft_p95", 0.001, 100.0, 1.0, 7), ("r", "ttft_p95", None, 100.0, 1.0, 7)], "run_id string, feature string, value double, sd double, severity double, seed int")
    sd = spark.createDataFrame([("ttft_p95", 100.0)], "feature string, sd double")
    a = R.gaussian_noise(df.drop("sd"), sd, []).collect()
    assert all(r.value is None or r.value >= 0 for r in a) and sum(r.value is None for r in a) == 1


def test_masks_are_nested(spark):
    df = spark.createDataFrame([(f"r{i}", "f", 1.0) for i in range(400)], "run_id string, feature string, value double")
    rows = R.random_missing(R.grid(df, "missingness", (0.1, 0.5), (1,))).collect()
    gone = {s: {r.run_id for r in rows if r.severity == s and r.value is None} for s in (0.1, 0.5)}
    assert gone[0.1] < gone[0.5] and 20 <= len(gone[0.1]) <= 60


def test_auc(spark):
    df = spark.createDataFrame([("m", 1.0, 0.5, 1.0)], "m string, axis double, y double, clean double")
    assert R.robustness_auc(df, ["m"]).collect()[0].robustness_auc == 0.75


def test_confounds(spark):
    df = spark.createDataFrame([("input", 1.0), ("output", 1.0), ("load", 3.0)], "f string, d double")
    assert [r[0] for r in df.select(D.queue_confounded(F.col("f"), F.col("d"))).collect()] == [True, True, False]


# Published calibration summaries, eight control runs per family.
CALIBRATION = {
    "BASELINE": (
        [0.047128599999996364, 0.05560458990476036, 0.04647132915270048, 0.051430203849668024, 0.05483413544425275, 0.0576625919464277, 0.05316918990065459, 0.0486315163441759],
        [0.1642050874997949, 0.1768457920046785, 0.15868606424810422, 0.17014284790384407, 0.1758571357506298, 0.18544451489688074, 0.17433820414953516, 0.1670287124990864],
        [0.11682928544869356, 0.1231612687537563, 0.11294134644849692, 0.11804291425214615, 0.12314425450276757, 0.13048764759732875, 0.12293798475220684, 0.11758568540171836],
    ),
    "OUTPUT_CONTROL": (
        [0.06277845800141221, 0.058962008947491984, 0.05402643749985145, 0.05565660145184664, 0.05491419104582747, 0.04674419169678002, 0.05572777709858201, 0.057969770502313604],
        [0.25169348125491525, 0.23657622085120236, 0.2329800107538176, 0.23560208155286086, 0.23104661279976427, 0.1878433479490922, 0.23037171665055206, 0.23846860029625527],
        [0.18690802325509137, 0.17499494409785255, 0.18224218960531288, 0.18122604440395657, 0.17520046665231348, 0.14410163124921374, 0.1780153277020872, 0.17883525624856697],
    ),
}


def test_published_service_levels(spark):
    """Limits of the published calibration. The record used a t quantile of six decimals, hence the tolerance."""
    rows = [(0, c, r + 1, *(col[r] for col in cols)) for c, cols in CALIBRATION.items() for r in range(8)]
    runs = spark.createDataFrame(rows, "campaign_id long, condition_id string, repetition int, " + ", ".join(f"{m} double" for m in D.SLO_LIMITS))
    got = {r.metric: r for r in I.slo_calibration(runs).collect()}
    for metric, limit in D.SLO_LIMITS.items():
        assert got[metric].final_threshold == pytest.approx(limit, abs=1e-8) and got[metric].enough_runs == 1
    short = {r.metric: r.enough_runs for r in I.slo_calibration(runs.where("repetition < 8")).collect()}
    assert set(short.values()) == {0}


def test_published_fold_comparison(spark):
    df = spark.createDataFrame([("h", f, d) for f, d in enumerate((0.6, 0.4, 0.4, 0.4, 0.4, 0.4, 0.4, 0.4))], "g string, f int, value double")
    r = I.signflip_mean(df, ["g"], "f").collect()[0]
    assert r.mean == pytest.approx(0.425) and r.signflip_p == 0.0078125


def test_published_frontier(spark):
    from tailwatch.operators.cost import pareto

    rows = [("T0_FULL", 0.575, 0.6875, 603.0375), ("T1_NO_HOST", 0.6, 0.625, 508.25624999999997), ("T2_NO_RUNTIME", 0.575, 0.6875, 545.1625), ("T3_LIGHT", 0.6, 0.625, 448.3229166666667)]
    df = spark.createDataFrame([("all", *r) for r in rows], "g string, config string, quality double, alarm double, bytes double")
    kept = [r.config for r in pareto(df, ["g"], "quality", ("alarm", "bytes")).collect() if not r.pareto_dominated]
    assert kept == ["T3_LIGHT"]
