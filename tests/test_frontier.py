"""The cost frontier: groups of few points compared in their row, larger ones swept, both against the pairwise rule."""

import random

import pytest

from tailwatch.operators import cost as K

RNG = random.Random(5)
POINTS = [(g, i, *[None if RNG.random() < 0.05 else float(RNG.randrange(8)) for _ in range(3)]) for g in (1, 2, None) for i in range(40)]


def beaten(p):
    beats = lambda o: None not in (*o[2:], *p[2:]) and o[2] >= p[2] and o[3] <= p[3] and o[4] <= p[4] and o[2:] != p[2:]
    return int(any(beats(o) for o in POINTS if o[0] == p[0]))


@pytest.mark.parametrize("few", [K.FEW_POINTS, 10])
def test_points_with_gaps_neither_beat_nor_are_beaten(spark, few):
    df = spark.createDataFrame(POINTS, "g int, i int, q double, a double, b double")
    got = {(r.g, r.i): r.pareto_dominated for r in K.pareto(df, ["g"], "q", ("a", "b"), few=few).collect()}
    assert got == {p[:2]: beaten(p) for p in POINTS} and 0 < sum(got.values()) < len(got)


def test_few_points_need_no_group_function(spark):
    df = spark.createDataFrame(POINTS, "g int, i int, q double, a double, b double")
    plan = K.pareto(df, ["g"], "q", ("a", "b"))._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Join" not in plan
