"""Folds follow the repetitions that occur; large doubles survive; the lifecycle stream orders whole triggers."""

import uuid

import pytest
from pyspark.sql import functions as F

from tailwatch.functions.core import round_doubles
from tailwatch.operators import cost as K
from tailwatch.operators import diagnose as G
from tailwatch.operators.quality import TRANSITIONS
from tailwatch.session import checkpoint_dir
from tailwatch.streaming import monitors as M
from tailwatch.streaming import stateful as ST


@pytest.mark.parametrize("repetitions", [6, 8, 10])
def test_every_repetition_is_tested_once(spark, repetitions):
    rows = spark.createDataFrame([(c, r, d) for c in (1, 2) for r in range(1, repetitions + 1 + c) for d in (0, 1, 2)], "campaign_id long, repetition int, degree int")
    for protocol in ("P1", "P2"):
        out = G.split_folds(rows, protocol).groupBy("campaign_id", "fold", "role").count().collect()
        for c in (1, 2):
            n = repetitions + c
            mine = {(r.fold, r.role): r["count"] for r in out if r.campaign_id == c}
            assert mine == {(f, "test"): 3 for f in range(1, n + 1)} | {(f, "train"): (n - 1) * (2 if protocol == "P1" else 3) for f in range(1, n + 1)}


def test_rounding_keeps_large_values(spark):
    rows = spark.createDataFrame([(1e14,), (-3e15,), (0.1234567,), (None,), (2.5,)], "x double")
    assert [r.x for r in round_doubles(rows).collect()] == [pytest.approx(1e14, rel=1e-12), pytest.approx(-3e15, rel=1e-12), 0.123457, None, 2.5]


def test_rounding_keeps_small_p_values(spark):
    rows = spark.createDataFrame([(4e-7,), (1.23456e-4,), (-2.5e-6,), (3e-13,), (-3e-13,), (0.0009999999,)], "x double")
    assert [r.x for r in round_doubles(rows).collect()] == [4e-7, 1.23456e-4, -2.5e-6, 0.0, 0.0, 0.001]


def test_lifecycle_stream_orders_over_batches(spark):
    """One good run in shuffled order over several files and Arrow batches: nothing is found."""
    path, at = ["PLANNED"], "PLANNED"
    while TRANSITIONS[at]:
        at = next((s for s in TRANSITIONS[at] if s not in path and s != "FAILED"), None)
        if at is None:
            break
        path.append(at)
    events = [("r", i, float(i), "state", s) for i, s in enumerate(path)] + [("r", len(path) + i, float(len(path) + i), "note", None) for i in range(400)]
    rows = spark.createDataFrame(events, "run_id string, event_seq long, monotonic_time double, event_type string, state string").withColumn("event_time", F.timestamp_seconds(F.lit(86_400) + F.col("monotonic_time")))
    folder = f"{checkpoint_dir(spark)}/shuffled-{uuid.uuid4().hex}"
    rows.orderBy(F.xxhash64("event_seq")).repartition(3).write.parquet(folder)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert M.run_available(ST.lifecycle(spark.readStream.schema(rows.schema).parquet(folder))).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_frontier_levels_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    points = [(1, rng.randint(0, 30) / 10, rng.randint(0, 30) / 10, rng.randint(0, 30) / 10) for _ in range(600)]
    got = K.pareto(spark.createDataFrame(points, "k int, q double, a double, b double"), ["k"], "q", ("a", "b"), salts=3).collect()
    beaten = lambda p: any(o[1] >= p[1] and o[2] <= p[2] and o[3] <= p[3] and o[1:] != p[1:] for o in points)
    assert all(r.pareto_dominated == int(beaten((r.k, r.q, r.a, r.b))) for r in got) and len(got) == 600
