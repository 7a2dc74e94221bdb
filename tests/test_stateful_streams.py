"""Stateful monitors over several files and triggers, against their batch twins."""

import datetime as dt
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tailwatch.operators import quality as Q
from tailwatch.operators import temporal as T
from tailwatch.session import checkpoint_dir
from tailwatch.streaming import monitors as M
from tailwatch.streaming import stateful as ST

RUN = ["campaign_id", "condition_id", "repetition", "run_id"]
START = dt.datetime(2026, 1, 1)


def moment(seconds):
    return START + dt.timedelta(seconds=seconds)


def streamed(spark, parts, schema, build):
    """The stream's rows after one file a trigger, and the progress of every trigger."""
    base = f"{checkpoint_dir(spark)}/test-{uuid.uuid4().hex}"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in-{i:03d}")
    # one folder per file: the order of arrival is the order of the names
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{base}/in-*")
    out = build(stream)
    with ST.state_store(spark):
        query = out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        progress = [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
    return spark.read.schema(out.schema).parquet(f"{base}/out").collect(), progress


GAUGE = "campaign_id long, condition_id string, repetition int, run_id string, request_id string, at double, step int, event_time timestamp"
REQUESTS = "campaign_id long, condition_id string, repetition int, run_id string, request_id string, actual_arrival double, completion_time double"


def test_gauge_equals_batch_over_triggers(spark):
    rng = random.Random(4)
    requests = [(0, "C", 1, f"r{i % 3}", f"q{i:04d}", round(i * 0.7, 3), round(i * 0.7 + rng.choice([0.0, 0.5, 9.0, 45.0]), 3)) for i in range(240)]
    events = []
    for *run, name, a, c in requests:
        events += [(*run, name, a, 1, moment(a)), (*run, name, c, -1, moment(c))]
    # out of order by up to thirty seconds, in ten files
    events.sort(key=lambda e: e[5] + rng.uniform(0, 30))
    size = len(events) // 10
    parts = [events[i:i + size] for i in range(0, len(events), size)]
    parts += [[(9, "beat", 1, "beat", "beat", 0.0, 0, moment(10_000))], [(9, "beat", 1, "beat", "beat2", 0.0, 0, moment(20_000))]]
    rows, progress = streamed(spark, parts, GAUGE, lambda s: ST.in_flight(s, RUN, cap=8, delay="40 seconds"))
    got = {(r.run_id, r.request_id): (r.at, r.outstanding, r.breach) for r in rows}
    want = {(r.run_id, r.request_id): (r["at"], r.outstanding, r.breach) for r in T.in_flight(spark.createDataFrame(requests, REQUESTS), RUN, cap=8).collect()}
    assert got == want and any(b for *_, b in want.values())
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    # nothing but the last heartbeat is left, and on the way never all events
    assert len(kept) >= 10 and kept[-1] <= 2 and max(kept) < len(events) / 2


def test_gauge_holds_the_runs_of_a_campaign_together(spark):
    rng = random.Random(11)
    requests = [(i % 2, [None, "C", "D", "D"][i % 4], i % 4, f"r{i % 4}", f"q{i:04d}", round(i * 0.7, 3), round(i * 0.7 + rng.choice([0.0, 0.5, 9.0, 45.0]), 3)) for i in range(240)]
    events = []
    for *run, name, a, c in requests:
        events += [(*run, name, a, 1, moment(a)), (*run, name, c, -1, moment(c))]
    events.sort(key=lambda e: e[5] + rng.uniform(0, 30))
    parts = [events[i:i + 60] for i in range(0, len(events), 60)]
    parts += [[(9, "beat", 1, "beat", "beat", 0.0, 0, moment(10_000))], [(9, "beat", 1, "beat", "beat2", 0.0, 0, moment(20_000))]]
    rows, progress = streamed(spark, parts, GAUGE, lambda s: ST.in_flight(s, RUN, cap=2, delay="40 seconds", held_by=["campaign_id"]))
    got = sorted((r.campaign_id, str(r.condition_id), r.repetition, r.run_id, r.request_id, r["at"], r.outstanding, r.breach) for r in rows)
    # a key of the batch query is not null
    batch = T.in_flight(spark.createDataFrame([(r[0], str(r[1]), *r[2:]) for r in requests], REQUESTS), RUN, cap=2).collect()
    assert got == sorted((r.campaign_id, r.condition_id, r.repetition, r.run_id, r.request_id, r["at"], r.outstanding, r.breach) for r in batch)
    assert any(g[-1] for g in got)
    operators = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    # two campaigns and the heartbeat: a state, a timer and the parts of some blocks each, however many runs they have
    assert operators[-1]["numRowsTotal"] <= 4 and max(o["numRowsTotal"] for o in operators) < 120


LIFE = "campaign_id long, condition_id string, repetition int, run_id string, event_seq int, event_type string, state string, monotonic_time double, event_time timestamp"
GOOD = ["PLANNED", "PREPARING", "WARMUP", "BASELINE", "RECOVERY", "COMPLETE"]


def life(run, states, start=0.0, skip=()):
    rows = []
    for i, s in enumerate(states):
        name, at = s if isinstance(s, tuple) else (s, start + 10.0 * i)
        if i not in skip:
            rows.append((0, "C", 1, run, i, "state", name, at, moment(at)))
    return rows


def test_lifecycle_is_in_order_over_triggers(spark):
    runs = {
        "good": life("good", GOOD), "later": life("later", GOOD, 35.0), "back": life("back", ["PLANNED", "PREPARING", ("WARMUP", 5.0), *GOOD[3:]]), "jump": life("jump", ["PLANNED", "RECOVERY", "COMPLETE"]),
        "first": life("first", GOOD[1:]), "twice": life("twice", [*GOOD, "COMPLETE"]), "odd": life("odd", ["PLANNED", "NEW", "PREPARING", "FAILED"]), "lost": life("lost", GOOD, skip=(2,)),
    }
    events = [e for rows in runs.values() for e in rows]
    rng = random.Random(9)
    events.sort(key=lambda e: e[7] + rng.uniform(0, 25))
    parts = [events[i:i + 6] for i in range(0, len(events), 6)]
    beats = [[(9, "beat", 1, "beat", i, "heartbeat", None, 0.0, moment(100_000 * (i + 1)))] for i in range(3)]
    rows, progress = streamed(spark, parts + beats, LIFE, lambda s: ST.lifecycle(s, delay="40 seconds", linger_seconds=60))
    got = sorted((r.run_id, r.subject, r.code) for r in rows)
    batch = Q.lifecycle_issues(spark.createDataFrame(events, LIFE)).select("run_id", "subject", "code").collect()
    # the batch rule also reports runs without a terminal state, which a stream cannot know
    want = sorted((r.run_id, r.subject, r.code) for r in batch)
    assert got == want
    assert {c for _, _, c in got} == {"event_time_not_monotonic", "illegal_lifecycle_transition", "lifecycle_not_started_at_planned", "terminal_state_count", "unknown_lifecycle_state"}
    assert not any(r[0] in ("good", "later") for r in got)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    # all runs end, so their state is dropped; the heartbeat's is left
    assert max(kept) > 4 and kept[-1] <= 2


def test_lifecycle_holds_the_runs_of_a_campaign_together(spark):
    runs = {
        "back": life("back", ["PLANNED", "PREPARING", ("WARMUP", 5.0), *GOOD[3:]]), "jump": life("jump", ["PLANNED", "RECOVERY", "COMPLETE"]), "first": life("first", GOOD[1:]),
        "twice": life("twice", [*GOOD, "COMPLETE"]), "odd": life("odd", ["PLANNED", "NEW", "PREPARING", "FAILED"]), "lost": life("lost", GOOD, skip=(2,)), "later": life("later", GOOD, 35.0),
    } | {f"good{i}": life(f"good{i}", GOOD, float(i)) for i in range(40)}
    events = [(len(name) % 2, *e[1:]) for name, rows in runs.items() for e in rows]
    rng = random.Random(3)
    events.sort(key=lambda e: e[7] + rng.uniform(0, 25))
    parts = [events[i:i + 60] for i in range(0, len(events), 60)]
    beats = [[(9, "beat", 1, "beat", i, "heartbeat", None, 0.0, moment(100_000 * (i + 1)))] for i in range(2)]
    rows, progress = streamed(spark, parts + beats, LIFE, lambda s: ST.lifecycle(s, delay="40 seconds", linger_seconds=60, held_by=["campaign_id"]))
    got = sorted((r.run_id, r.subject, r.code) for r in rows)
    assert got == sorted((r.run_id, r.subject, r.code) for r in Q.lifecycle_issues(spark.createDataFrame(events, LIFE)).collect())
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    # a state and a timer for each of two campaigns and the heartbeat, not for each of 47 runs
    assert 2 <= max(kept) <= 12 and kept[-1] <= 2


def test_lifecycle_events_after_their_turn(spark):
    first = life("a", GOOD[:3])
    rows, _ = streamed(spark, [first, [first[1]], life("a", GOOD)[3:]], LIFE, lambda s: ST.lifecycle(s, delay="10 minutes"))
    assert [(r.run_id, r.subject, r.code) for r in rows] == [("a", "1", "event_out_of_turn")]


@pytest.mark.parametrize("n", [50, 60_000])
def test_window_quantile_has_the_stated_rank_error(spark, n):
    rng = random.Random(n)
    values = [rng.lognormvariate(0, 1) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "completion_time double").select(
        F.lit(0.0).alias("actual_arrival"), "completion_time", F.lit("success").alias("status"), F.lit(START).alias("ts")).repartition(7)
    got = M.slo_windows(df, "ts", [], 1.0).collect()[0].p95_latency
    rank = sum(v <= got for v in values)
    assert got in values and abs(rank - 0.95 * n) <= max(1, n / M.SUMMARY)
