"""The degradation grid judged in a pair's task, against the row route and plain Spark expressions."""

import pytest
from pyspark.sql import functions as F

from tailwatch.functions import draws as DR
from tailwatch.functions.core import portable_normal, portable_uniform
from tailwatch.operators import diagnose as G
from tailwatch.operators import pairs as P
from tailwatch.operators import scoring as S
from tailwatch.plans import load
from tailwatch.plans import tables as V


@pytest.fixture(scope="module")
def queries():
    load()
    from tailwatch.plans import robustness_queries

    return robustness_queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A source and its target with runs of unequal length, a request that stands twice, and a pair that has no source."""
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    short = events.where("(event_id < 8320 or event_id between 12480 and 16639) and event_id % 4160 < 1456 and event_id % 17 <> 3 and event_id % 173 <> 20")
    path = str(tmp_path_factory.mktemp("pairs"))
    short.unionByName(events.where("event_id in (210, 4200)")).coalesce(2).write.parquet(f"{path}/events.parquet")
    return path


def test_draws_equal_the_portable_ones(spark):
    seeds, ids, names = [7, 8101, 8102], ["c1-r01-baseline", "c1234-r08-output-downstream-control", "é"], ["3", "", "dependency_fraction_of_gateway_median", "x" * 90]
    grid = spark.createDataFrame([(i, s, n) for i in ids for s in seeds for n in names], "i string, s int, n string")
    rows = grid.select("*", portable_uniform(F.col("s"), F.col("i"), F.col("n")).alias("u"), portable_normal(F.col("s"), F.col("i"), F.col("n")).alias("z")).collect()
    uniform, normal = DR.portable_uniforms(seeds, ids, names), DR.portable_normals(seeds, ids, names)
    for r in rows:
        at = ids.index(r.i), seeds.index(r.s), names.index(r.n)
        assert uniform[at] == r.u and normal[at] == pytest.approx(r.z, abs=1e-12)


def test_counts_of_a_task_equal_those_of_rows(spark, folder, queries):
    pairs = spark.createDataFrame([(0,), (1,)], "pair_id long")
    read = lambda df: sorted(str(tuple(r[c] for c in ("campaign_id", "condition_id", "repetition", "method", *queries.POINT, "predicted_set", "n"))) for r in df.collect())
    counts = queries.point_counts(spark, folder, queries.GRID.families)
    assert read(counts) == read(queries.row_counts(spark, folder, pairs))
    assert {r.campaign_id for r in counts.select("campaign_id").distinct().collect()} == {0, 1}
    assert P.large_pairs(V.requests(spark, folder)).count() == 0


def test_large_pairs_take_the_row_route(spark, folder, queries, monkeypatch):
    plain = queries.point_counts(spark, folder, queries.PLAIN)
    kept = dict(V._kept)
    monkeypatch.setattr(P, "MOST_RUNS", 10)
    V._kept = {k: v for k, v in kept.items() if not k[0].startswith("robust-counts")}
    try:
        assert P.large_pairs(V.requests(spark, folder)).count() == 2
        assert sorted(map(str, queries.point_counts(spark, folder, queries.PLAIN).select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    finally:
        V._kept = kept


def test_requests_are_dealt_once_and_points_never(spark, folder, queries):
    known = {r["condition_id"]: (r["degree"], r["truth_set"], [r[c] for c in G.LABELS]) for r in G.labels(spark).collect()}
    counts = P.point_counts(P.pair_requests(V.sampled_requests(spark, folder)), known, queries.READ, queries.GRID)
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_lost_channels_draw_nothing(spark, folder):
    """A screen of lost channels, the frontier and the target's test build neither masks nor the whole grid."""
    kept = dict(V._kept)
    V._kept = {}
    try:
        for name in ("quality_screen", "transfer_test"):
            load()[name].build(spark, folder).collect()
        assert {k[0] for k in V._kept} == {"robust-counts-plain", "robust-retained-plain"}
    finally:
        V._kept = kept


def test_weighted_metrics_equal_those_of_rows(spark):
    causes = [c[6:] for c in G.LABELS]
    rows = [("a", *[int(i + j == 2) for j in range(4)], *[int((i * j) % 3 == 1) for j in range(4)], i % 4) for i in range(9)]
    df = spark.createDataFrame(rows, ", ".join(["k string", *[f"true_{c} int" for c in causes], *[f"pred_{c} int" for c in causes], "n int"]))
    long = df.withColumn("_r", F.explode(F.sequence(F.lit(1), "n"))).where("n > 0").drop("_r", "n")
    held = df.where("n > 0")
    for metrics in (S.set_metrics, S.cause_metrics):
        want, got = metrics(long, ["k"]), metrics(held, ["k"], "n")
        for a, b in zip(want.orderBy(want.columns[:2]).collect(), got.select(want.columns).orderBy(want.columns[:2]).collect(), strict=True):
            assert [x if isinstance(x, str) or x is None else pytest.approx(x) for x in a] == list(b)


def test_equal_scores_as_channel_by_channel():
    """One plan of levels gives the means that channels one by one give, bit for bit."""
    import numpy as np

    rng = np.random.default_rng(3)
    present = rng.random((60, len(G.PAIRS))) < 0.6
    present[:5] = False
    z = np.where(present, rng.uniform(-5, 5, present.shape), 0.0)
    values, there = G._score_matrix(z, present)
    for s, score in enumerate(G.SCORES):
        for g, group in enumerate(G.GROUPS):
            form = np.maximum(0.0, -z) if group == "X" else np.maximum(0.0, z) if group.endswith("_pos") else z
            parts = [G._mean([form[:, i] for i in ch], [present[:, i] for i in ch]) for ch in G._channels(*score, "M" if group == "X" else group[0])]
            value, any_ = G._mean([p[0] for p in parts], [p[1] for p in parts])
            at = s * len(G.GROUPS) + g
            assert (values[:, at] == value).all() and (there[:, at] == any_).all()


PLAIN, WHOLE = {"robust-counts-plain", "robust-retained-plain"}, {"robust-counts", "robust-retained"}


@pytest.mark.parametrize("name, tables", [
    ("quality_screen", PLAIN),
    ("multi_criteria", PLAIN | {"cost_runs"}),
    ("cause_robustness", {"robust-counts"}),
    ("robustness_seeds", WHOLE),
    ("auc_difference", WHOLE),
])
def test_only_counts_are_kept(spark, folder, name, tables):
    """No query of the grid writes runs, series, masks or a row a (run, point)."""
    kept = dict(V._kept)
    V._kept = {}
    try:
        assert load()[name].build(spark, folder).count() > 0 and {k[0] for k in V._kept} == tables
    finally:
        V._kept = kept
