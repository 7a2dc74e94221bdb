"""Bootstrap intervals: draws that stay in their task give what draws as rows give, also with gaps."""

from tailwatch.operators import csd as C


def test_intervals_of_both_ways_agree_and_small_groups_shuffle_no_draws(spark):
    rows = [(c, "INPUT_LOAD", r, f"f{j}", ((c * 5 + r * 7 + j * 3) % 11 - 4) / 3.0)
            for c in (1, 2) for r in (1, 2, 3, 5, 8) for j in range(4) if (c + r + j) % 9]
    res = spark.createDataFrame(rows, "campaign_id long, compound string, repetition int, feature string, z double")
    read = lambda df: {(r.campaign_id, r.compound): (round(r.bootstrap_low, 9), round(r.bootstrap_high, 9)) for r in df.collect()}
    as_rows, in_task = C.bootstrap_interval(res, 200, most=2), C.bootstrap_interval(res, 200)
    assert read(in_task) == read(as_rows) and len(read(in_task)) == 2
    assert "Generate" not in in_task._jdf.queryExecution().executedPlan().toString()


def test_a_rest_of_cancelled_sums_has_no_direction(spark):
    names = ["control_mean", "a_only_mean", "b_only_mean", "observed_mean", "predicted_mean", "raw_residual", "scale"]
    means = spark.createDataFrame([(1, "INPUT_LOAD", f, z, *[1.0] * 7) for f, z in (("a", -3e-15), ("b", 2e-14), ("c", 0.5), ("d", -0.5))],
                                  "campaign_id long, compound string, feature string, zbar double, " + ", ".join(f"{n} double" for n in names))
    found = {r.feature: r.interaction_direction for r in C.signature(means).collect()}
    assert found == {"a": "zero", "b": "zero", "c": "positive", "d": "negative"}
