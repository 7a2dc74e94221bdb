"""Degraded points as arrays in a run's row, against the long rows they stand for."""

from pyspark.sql import functions as F

from tailwatch.operators import degrade as R
from tailwatch.operators import diagnose as G
from tailwatch.operators import features as FT

NAMES = ["ttft_median", "host_cpu_median", "ttft_normalized_slope"]


def _runs(spark):
    return spark.createDataFrame([("r1", [0.1, 5.0, -1.0], [2.0, 1.0, 0.5]), ("r2", [0.3, None, 4.0], [2.0, 0.0, None])], "run_id string, x array<double>, noise_sd array<double>")


def _long(points):
    rows = points.select("run_id", F.explode("p").alias("p")).select("run_id", "p.severity", "p.seed", F.posexplode("p.x").alias("i", "value"))
    return sorted(str((r.run_id, r.severity, r.seed, NAMES[r.i], None if r.value is None else round(r.value, 9))) for r in rows.collect())


def _want(rows):
    return sorted(str((r.run_id, r.severity, r.seed, r.feature, None if r.value is None else round(r.value, 9))) for r in rows.collect())


def test_points_equal_long_rows(spark):
    runs = _runs(spark)
    seeds = F.array(F.lit(8101), F.lit(8102))
    long = runs.select("run_id", F.posexplode(F.arrays_zip("x", "noise_sd")).alias("i", "v")).select(
        "run_id", F.get(F.array(*[F.lit(n) for n in NAMES]), F.col("i")).alias("feature"), F.col("v.x").alias("value"), F.col("v.noise_sd").alias("sd"))
    missing = R.random_missing(R.grid(long, "missingness", R.MISSING_LEVELS, (8101, 8102)))
    assert _long(runs.withColumn("p", R.missing_points(NAMES, seeds))) == _want(missing)
    noisy = R.gaussian_noise(R.grid(long.drop("sd"), "noise", R.NOISE_LEVELS, (8101, 8102)), long.select("run_id", "feature", "sd"), ["run_id"])
    assert _long(runs.withColumn("p", R.noise_points(NAMES, seeds))) == _want(noisy)


def test_points_are_scored_without_a_shuffle(spark):
    names, width = sorted({*FT.F2, *G.PAIR_FEATURES}), len(FT.F2)
    nulls = lambda n: F.array_repeat(F.lit(None).cast("double"), n)
    arrays = {m: nulls(n) for m, n in G.model_widths(width).items()}
    arrays |= {"fill": F.array_repeat(F.lit(0.0), width), "scale_mu": F.array_repeat(F.lit(0.0), width), "scale_sd": F.array_repeat(F.lit(1.0), width)}
    arrays["centres"] = F.flatten(F.array(*[F.array_repeat(F.lit(2.0), width) if c in ("LOAD", "INPUT") else nulls(width) for c in G.CELLS]))
    rows = spark.range(2).withColumn("x", F.array_repeat(F.lit(1.0), len(names))).withColumns(arrays)
    sets = G.point_sets(G.scored_points(rows, names, FT.F2))
    assert "Exchange" not in sets._jdf.queryExecution().executedPlan().toString()
    # a tie goes to the smaller key; without directions the evidence methods say nothing
    assert sorted(map(tuple, sets.collect())) == [(0, "M1/F2", "INPUT"), (1, "M1/F2", "INPUT")]


def test_rows_meet_their_sd_before_points_multiply_them(spark):
    """The grid gives the rows of ``gaussian_noise``; the join is below both explodes."""
    rows = spark.createDataFrame([("r1", "ttft_median", 0.1), ("r1", "x", -1.0), ("r2", "ttft_median", None), ("r2", "x", 4.0)], "run_id string, feature string, value double")
    sd = spark.createDataFrame([("ttft_median", 2.0)], "feature string, sd double")
    found = R.noise_grid(rows, sd, [], R.NOISE_LEVELS, F.array(F.lit(8101), F.lit(8102)))
    assert _want(found) == _want(R.gaussian_noise(R.grid(rows, "noise", R.NOISE_LEVELS, (8101, 8102)), sd, [])) and found.count() == 24
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and plan.rindex("Generate explode") < plan.index("Join LeftOuter")
