"""Readers, log parsing, quality rules and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tailwatch.operators import derive as D
from tailwatch.operators import quality as Q
from tailwatch.sources import artifacts as A
from tailwatch.sources import logs as LG
from tailwatch.sources import telemetry as S
from tailwatch.streaming import monitors as M


def test_declared_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r-req-000001", 1, 0.5)], "request_id string, sequence int, actual_arrival double")
    S.write_table(df, str(tmp_path / "runs/a/requests.parquet"), S.REQUESTS)
    back = S.read_table(spark, str(tmp_path / "runs"), "requests").collect()[0]
    assert back.sequence == 1 and back.status is None and back.completion_time is None
    with pytest.raises(ValueError):
        S.write_table(df, str(tmp_path / "bad"), S.T.StructType([S.T.StructField("x", S.T.BooleanType())]))


def test_typed_csv(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("name,n,x,flag\nstring,int64,float64,bool\na,1,2.5,True\nb,,,False\n")
    rows = {r.name: r for r in S.read_typed_csv(spark, str(f)).collect()}
    assert rows["a"].n == 1 and rows["a"].x == 2.5 and rows["a"].flag is True
    assert rows["b"].n is None and rows["b"].x is None and rows["b"].flag is False


def test_documents_keep_broken_files(spark, tmp_path):
    for name, text in (("a", json.dumps({"n": 1}, indent=2)), ("b", '{"n": 1')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "config.json").write_text(text)
    docs = S.read_documents(spark, str(tmp_path / "*/config.json"), "n bigint").cache()
    assert {r.run_id: r.n for r in docs.collect()} == {"a": 1, "b": None}
    assert [r.run_id for r in A.corrupt_documents(docs).collect()] == ["b"]


def test_metric_lines(spark):
    body = '# HELP\nrequests_deferred{a="b"} 3\nrequests_processing 4e0\nbad line\n\n'
    rows = LG.metric_rows(spark.createDataFrame([(1, body)], "id int, body string")).collect()
    assert [(r.metric_name, r.metric_value, r.labels) for r in rows] == [("requests_deferred", 3.0, 'a="b"'), ("requests_processing", 4.0, "")]


def test_stream_timing(spark):
    lines = [(0.0, ": ping"), (1.0, 'data: {"choices":[{"text":""}]}'), (2.0, 'data: {"choices":[{"text":"x","finish_reason":"length"}]}'),
             (3.0, 'data: {"usage":{"prompt_tokens":5,"completion_tokens":6,"prompt_ms":1500}}'), (4.0, "data: [DONE]")]
    df = spark.createDataFrame([("r", t, x) for t, x in lines], "id string, ts double, line string")
    r = LG.stream_timing(df, ["id"]).collect()[0]
    assert (r.first_token_time, r.finish_reason, r.server_prompt_tokens, r.server_output_tokens, r.server_prompt_seconds, r.saw_end) == (2.0, "length", 5, 6, 1.5, 1)


def test_interval_text(spark):
    df = spark.createDataFrame([(0.1234567, 0.1, 0.2), (1.0, None, 2.0)], "m double, l double, h double")
    a, b = [r[0] for r in df.select(D.interval_text(F.col("m"), F.col("l"), F.col("h"))).collect()]
    assert a.startswith("0.123457 [0.1") and b == ""


def test_fingerprint_ignores_order_but_not_values(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "i int, s string")
    c = spark.createDataFrame([(2, "y"), (1, "z")], "i int, s string")
    assert A.repeat_audit(a, b).collect()[0].identical == 1
    assert A.repeat_audit(a, c).collect()[0].identical == 0


def run_events(states):
    return [(0, "C", 1, "r", i, "state", s, float(t)) for i, (s, t) in enumerate(states)]


EVENTS = "campaign_id long, condition_id string, repetition int, run_id string, event_seq int, event_type string, state string, monotonic_time double"
GOOD = [("PLANNED", 0), ("PREPARING", 1), ("WARMUP", 2), ("BASELINE", 3), ("RECOVERY", 4), ("COMPLETE", 5)]


@pytest.mark.parametrize("change, code", [
    (None, None), ((1, ("PREPARING", -1)), "event_time_not_monotonic"), ((2, ("RECOVERY", 2)), "illegal_lifecycle_transition"),
    ((0, ("WARMUP", 0)), "lifecycle_not_started_at_planned"), ((5, ("RECOVERY", 5)), "terminal_state_count"), ((3, ("ODD", 3)), "unknown_lifecycle_state"),
])
def test_lifecycle_rules(spark, change, code):
    states = list(GOOD)
    if change:
        states[change[0]] = change[1]
    codes = {r.code for r in Q.lifecycle_issues(spark.createDataFrame(run_events(states), EVENTS)).collect()}
    assert (code in codes) if code else not codes


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "success" if i % 3 else "failed", 0.0, 0.1 * (i % 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, status string, actual_arrival double, completion_time double").withColumn("ts", F.timestamp_seconds(F.col("i") * 60))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {r.window_start: r for r in M.run_available(M.slo_windows(stream, "ts", [], 0.5)).collect()}
    want = {r.window_start: r for r in M.slo_windows(df, "ts", [], 0.5).collect()}
    assert len(got) >= len(want) - 2
    for k, r in got.items():
        assert (r.requests, r.violations, r.max_latency, r.p95_latency) == (want[k].requests, want[k].violations, want[k].max_latency, want[k].p95_latency)


def test_plans_push_filters_and_avoid_cross_joins(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("string").alias("status"), F.lit(1.0).alias("unused"))
    df.write.parquet(str(tmp_path / "t"))
    q = spark.read.parquet(str(tmp_path / "t")).where("status = '1'").groupBy("status").agg(F.count("id"))
    text = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,1)]" in text and "unused" not in text
