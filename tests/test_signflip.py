"""Exact sign-flip tests against counts by dynamic programming and against all patterns."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailwatch.operators import csd as C
from tailwatch.operators import signflip as S


def exact_p(values):
    """Share of sign patterns whose absolute sum reaches the observed one, for whole numbers."""
    sums = Counter({0: 1})
    for v in values:
        nxt = Counter()
        for s, n in sums.items():
            nxt[s + v] += n
            nxt[s - v] += n
        sums = nxt
    return sum(n for s, n in sums.items() if abs(s) >= abs(sum(values))) / 2 ** len(values)


def mean_rows(spark, groups):
    return spark.createDataFrame([(g, i, float(v)) for g, vs in groups.items() for i, v in enumerate(vs)], "g string, r int, value double")


@pytest.mark.parametrize("hot_rows", [None, 50])
def test_mean_is_exact_past_twenty(spark, hot_rows):
    rng = random.Random(8)
    groups = {f"n{n}": [rng.randint(-40, 60) for _ in range(n)] for n in (1, 2, 3, 9, 20, 21, 30)}
    groups |= {"zero": [0] * 25, "balanced": [1, -1] * 12, "one sign": [5] * 30}
    got = {r.g: r for r in S.signflip_mean(mean_rows(spark, groups), ["g"], "r", hot_rows=hot_rows).collect()}
    assert {g: r.signflip_p for g, r in got.items()} == {g: pytest.approx(exact_p(v), abs=1e-15) for g, v in groups.items()}
    assert {r.method for r in got.values()} == {"exact"}
    assert got["one sign"].signflip_p == 2 / 2 ** 30


def test_larger_groups_say_what_they_are(spark):
    groups = {"small": [1, 2, 3], "large": [1, 2, 3, -4] * 14}
    plain = {r.g: r for r in S.signflip_mean(mean_rows(spark, groups), ["g"], "r").collect()}
    assert (plain["small"].method, plain["large"].method, plain["large"].signflip_p) == ("exact", "not computed", None)
    drawn = {r.g: r for r in S.signflip_mean(mean_rows(spark, groups), ["g"], "r", draws=4000).collect()}
    assert (drawn["small"].method, drawn["large"].method) == ("exact", "draws=4000")
    assert drawn["small"].signflip_p == exact_p(groups["small"])
    assert drawn["large"].signflip_p == pytest.approx(exact_p(groups["large"]), abs=0.03)


def vector_rows(spark, groups):
    """groups: name -> {feature: values by repetition, None where it is missing}."""
    rows = [(1, g, f, i, float(v)) for g, fs in groups.items() for f, vs in fs.items() for i, v in enumerate(vs) if v is not None]
    df = spark.createDataFrame(rows, "campaign_id long, compound string, feature string, repetition int, z double")
    return df.withColumns({c: F.lit(1.0) for c in ("a0b0", "a1b0", "a0b1", "a1b1", "predicted", "delta", "scale")})


def test_vector_matches_all_patterns(spark):
    rng = np.random.default_rng(4)
    groups = {f"n{n}": {f"f{k}": rng.normal(0.4, 1, n).tolist() for k in range(3)} for n in (1, 2, 5, 11)}
    groups["n11"]["f1"][4] = None
    want = {}
    for g, fs in groups.items():
        sums = []
        for signs in itertools.product((-1, 1), repeat=len(fs["f0"])):
            sums.append(np.sqrt(np.mean([np.mean([s * v for s, v in zip(signs, vs, strict=True) if v is not None]) ** 2 for vs in fs.values()])))
        want[g] = float(np.mean(np.array(sums) + 1e-12 >= sums[-1]))
    got = {r.compound: r for r in C.signflip_vector(vector_rows(spark, groups)).collect()}
    assert {g: r.exact_p for g, r in got.items()} == want and {r.method for r in got.values()} == {"exact"}


def test_vector_is_exact_past_twenty(spark):
    """One feature of whole numbers: the statistic is the absolute mean, so patterns can be counted by their sums."""
    rng = random.Random(2)
    groups = {f"n{n}": {"f": [rng.randint(-30, 45) for _ in range(n)]} for n in (20, 21, 26, 30)}
    got = {r.compound: r.exact_p for r in C.signflip_vector(vector_rows(spark, groups)).collect()}
    assert got == {g: exact_p(fs["f"]) for g, fs in groups.items()}


def test_vector_above_reach(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_VECTOR", 4)
    groups = {"small": {"a": [1, 2, 3], "b": [2, 2, 1]}, "large": {"a": [1, 2, 3, 4, 2, 1], "b": [1, 1, 1, 1, 1, 1]}}
    plain = {r.compound: r for r in C.signflip_vector(vector_rows(spark, groups)).collect()}
    assert (plain["large"].method, plain["large"].exact_p) == ("not computed", None)
    drawn = {r.compound: r for r in C.signflip_vector(vector_rows(spark, groups), draws=3000).collect()}
    assert drawn["large"].method == "draws=3000" and drawn["large"].exact_p == pytest.approx(2 / 64, abs=0.015)
    assert drawn["small"].exact_p == plain["small"].exact_p


def test_merge_has_no_pair_of_rows(spark):
    """The number of rows grows with half of the patterns' exponent."""
    df = mean_rows(spark, {"a": list(range(1, 31))})
    text = S.signflip_mean(df, ["g"], "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in text and S._signed_sums(df.limit(1).select(F.array(*[F.lit(1.0)] * 15).alias("v")), "v").count() == 1 << 15
