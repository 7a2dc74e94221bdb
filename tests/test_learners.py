"""Fits satisfy their optimality conditions, and both routes agree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailwatch.operators import learners as L


def data(n=200, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where(x @ np.array([1.0, -2.0, 0.5]) + rng.normal(size=n) > 0.8, 1.0, -1.0)
    return x, y


@pytest.mark.parametrize("loss", ["logistic", "hinge"])
def test_gradient_vanishes(loss):
    x, y = data()
    w = L.newton_fit(x, y, loss)
    xa = np.hstack([x, np.ones((len(x), 1))])
    n, pos = len(y), (y > 0).sum()
    s = np.where(y > 0, n / (2 * pos), n / (2 * (n - pos)))
    g, _ = L._sums(xa, y, s, w, loss)
    assert np.abs(g + w).max() < 1e-6


def test_routes_agree(spark):
    rows = []
    for g in ("a", "b"):
        x, y = data(300, 1 if g == "a" else 2)
        rows += [(g, [float(v) for v in xi], int(yi > 0)) for xi, yi in zip(x, y)]
    rows += [("one", [0.5, 0.5, 0.5], 1)] * 300
    df = spark.createDataFrame(rows, "g string, x array<double>, y int").repartition(4)
    for loss in ("logistic", "hinge"):
        small = {r.g: r.w for r in L.fit(df, ["g"], loss).collect()}
        large = {r.g: r.w for r in L.fit(df, ["g"], loss, hot_rows=100).collect()}
        assert small.keys() == large.keys()
        for g in small:
            assert large[g] == pytest.approx(small[g], abs=1e-6)


def test_score_and_decision(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "g string, x array<double>")
    w = spark.createDataFrame([("a", [0.5, -1.0, 0.25])], "g string, w array<double>")
    r = L.score(df, w, ["g"]).collect()[0]
    assert r.f == pytest.approx(-1.25) and r.decision == 0 and r.score == pytest.approx(1 / (1 + np.exp(1.25)))


def test_large_groups_take_the_same_descent_steps(spark):
    """Descent steps over summed gradients equal those of one task."""
    x, y = data(300, 4)
    df = spark.createDataFrame([("a", [float(v) for v in xi], int(yi > 0)) for xi, yi in zip(x, y)], "g string, x array<double>, y int").repartition(3)
    got = L.fit_together(df, ["g"], 1, "descent", steps=4).collect()[0].w
    assert got == pytest.approx(L.descent_fit(x, y, steps=4), abs=1e-9)


def test_large_groups_settle_on_features_of_unlike_scale(spark):
    """The damped fit over summed gradients ends where that of one task does."""
    x, y = data(300, 5)
    x = x * np.array([60.0, 1.0, 0.01])
    df = spark.createDataFrame([("a", [float(v) for v in xi], int(yi > 0)) for xi, yi in zip(x, y)], "g string, x array<double>, y int").repartition(3)
    for loss in ("logistic", "hinge"):
        got = L.fit(df, ["g"], loss, hot_rows=100).collect()[0].w
        assert got == pytest.approx(L.newton_fit(x, y, loss), abs=1e-6)


def test_unsettled_groups_are_flagged_and_hold_up_no_other(spark, monkeypatch):
    """One pass is too few for the large group; the small one beside it is fitted as ever."""
    rng = np.random.default_rng(3)
    rows = [(g, rng.normal(size=3).tolist(), int(rng.random() < 0.5)) for g, n in (("large", 300), ("small", 40)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, x array<double>, y int")
    monkeypatch.setattr(L, "MOST_PASSES", 2)
    got = {r.g: r for r in L.fit(df, ["g"], "logistic", hot_rows=100).collect()}
    assert (got["large"].settled, got["small"].settled) == (False, True)
    x, y = (np.array([r[i] for r in rows if r[0] == "small"]) for i in (1, 2))
    assert got["small"].w == pytest.approx(L.newton_fit(x, np.where(y == 1, 1.0, -1.0), "logistic"), abs=1e-9)
    monkeypatch.undo()
    assert {r.settled for r in L.fit(df, ["g"], "logistic", hot_rows=100).collect()} == {True}
