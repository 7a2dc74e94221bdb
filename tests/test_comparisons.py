"""Paired comparisons over blocks and version diffs on plain numbers."""

import pytest

from tailwatch.operators import compare as CP
from tailwatch.operators.design import CAUSES
from tailwatch.operators.scoring import set_metrics

SIDE = "campaign_id long, model string, fold int, recall double"


def side(spark, values, model="M2"):
    return spark.createDataFrame([(0, model, f, v) for f, v in enumerate(values, 1)], SIDE)


def test_published_gain_of_mixed_training(spark):
    """Eight folds whose recall rises by .425 on average: p is 2 of 256 patterns."""
    p1 = [0.2, 0.4, 0.3, 0.3, 0.5, 0.4, 0.4, 0.3]
    gain = [0.6, 0.4, 0.4, 0.4, 0.4, 0.4, 0.4, 0.4]
    r = CP.paired_blocks(side(spark, p1), side(spark, [a + g for a, g in zip(p1, gain, strict=True)]), ["campaign_id", "model"], "fold", "recall").collect()[0]
    assert (r.n, r.signflip_p, r.test, r.verdict) == (8, 0.0078125, "exact", "SUPPORTED")
    assert r["mean"] == pytest.approx(0.425) and r.median == pytest.approx(0.4)
    # t quantile .975 with seven degrees of freedom
    assert r.ci_high - r["mean"] == pytest.approx(2.364624 * r.sd / 8 ** 0.5, abs=1e-5)


def test_interval_collapses_at_equal_differences(spark):
    r = CP.paired_blocks(side(spark, [0.125] * 6), side(spark, [0.375] * 6), ["campaign_id", "model"], "fold", "recall").collect()[0]
    assert r.ci_low == r.ci_high == r["mean"] == 0.25 and r.signflip_p == 2 / 64 and r.verdict == "SUPPORTED"
    r = CP.paired_blocks(side(spark, [0.1] * 6), side(spark, [0.1] * 6), ["campaign_id", "model"], "fold", "recall").collect()[0]
    assert r.signflip_p == 1.0 and r.verdict == "NOT_SUPPORTED"


def test_blocks_of_one_side_do_not_count(spark):
    first, second = side(spark, [0.1, 0.2, None, 0.4]), side(spark, [0.3, 0.1, 0.9, 0.8, 0.9])
    r = CP.paired_blocks(first, second, ["campaign_id", "model"], "fold", "recall").collect()[0]
    assert r.n == 3 and r["mean"] == pytest.approx((0.2 - 0.1 + 0.4) / 3)
    assert CP.paired_blocks(first.where("false"), second, ["campaign_id", "model"], "fold", "recall").count() == 0


def test_version_diff_covers_every_metric(spark):
    names = ", ".join([f"true_{c} int" for c in CAUSES] + [f"pred_{c} int" for c in CAUSES])
    table = lambda rows: spark.createDataFrame([(m, *t, *p) for m, t, p in rows], f"method string, {names}")
    before = table([("A", (1, 1, 0, 0), (1, 0, 0, 0)), ("A", (1, 0, 1, 0), (1, 0, 1, 0)), ("OLD", (1, 0, 0, 0), (0, 0, 0, 0))])
    after = table([("A", (1, 1, 0, 0), (1, 1, 0, 0)), ("A", (1, 0, 1, 0), (1, 0, 1, 0)), ("NEW", (1, 0, 0, 0), (1, 0, 0, 0))])
    metrics = [c for c, t in set_metrics(before, ["method"]).dtypes if t == "double"]
    got = {(r.method, r.metric): (r.before, r.after, r.change) for r in CP.metric_diff(before, after, ["method"], metrics).collect()}
    assert len(got) == 3 * len(metrics)
    assert got["A", "exact_set_accuracy"] == (0.5, 1.0, 0.5) and got["A", "under_attribution"] == (0.5, 0.0, -0.5)
    assert got["OLD", "exact_set_accuracy"] == (0.0, None, None) and got["NEW", "exact_set_accuracy"] == (None, 1.0, None)
