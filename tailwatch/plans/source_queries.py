"""Queries over files, logs, fingerprints and streams derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import quality as Q
from ..sources import artifacts as A
from ..sources import logs as LG
from ..sources import telemetry as S
from ..sources.driver_views import RUN, requests_from
from ..session import checkpoint_dir
from ..streaming import monitors as M
from ..streaming import stateful as ST
from . import tables as V
from .oracle import TABLES
from .quality_queries import bounds, mechanisms, run_events
from .registry import query


# --- tables and documents --------------------------------------------------------------------------


@query("schema_projection", "S1 S2", "SELECT request_id, sequence, status, prompt_tokens, http_status IS NULL AS no_http, actual_arrival, finish_reason FROM (SELECT *, CAST(NULL AS BIGINT) AS http_status, CAST(NULL AS VARCHAR) AS finish_reason FROM req)", "actual_arrival")
def schema_projection(spark, sf):
    """Requests written under the declared schema and read back from the run folders."""

    def build():
        root = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
        S.write_table(V.requests(spark, sf), f"{root}/all/requests.parquet", S.REQUESTS)
        return S.read_table(spark, root, "requests")

    return V.keep("written", spark, sf, build).select(
        "request_id", "sequence", "status", "prompt_tokens", F.col("http_status").isNull().alias("no_http"), "actual_arrival", "finish_reason")


@query("run_set_scan", "S10", "SELECT run_id, count(*) AS requests FROM req WHERE repetition % 2 = 0 GROUP BY run_id")
def run_set_scan(spark, sf):
    index = bounds(spark, sf).where("repetition % 2 = 0").select("run_id")
    return V.requests(spark, sf).join(index, "run_id", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("requests"))


@query("run_index_gate", "S5 S6 S11", """SELECT run_id, reason FROM (SELECT run_id, 'not_eligible' AS reason FROM rb WHERE repetition = 1 UNION ALL SELECT run_id, 'source_hash' FROM rb WHERE repetition = 2
  UNION ALL SELECT run_id, 'superseded_path' FROM rb WHERE repetition = 3 UNION ALL SELECT run_id, 'duplicate_run_id' FROM rb WHERE repetition = 4 UNION ALL SELECT '*', 'row_count')""")
def run_index_gate(spark, sf):
    """An index written as JSON lines, read with its schema, and gated."""

    def build():
        r = F.col("repetition")
        rows = bounds(spark, sf).select(
            "run_id", F.concat(F.when(r == 3, "old/").otherwise("runs/"), "run_id").alias("run_path"), "condition_id", "repetition",
            F.when(r == 2, "other").otherwise("src").alias("source_hash"), F.lit("frz").alias("freeze_hash"), F.lit(None).cast("string").alias("artifact_manifest_hash"),
            (r != 1).alias("publication_analysis_eligible"))
        folder = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
        S.write_jsonl(rows.unionByName(rows.where("repetition = 4")), folder)
        return S.read_jsonl(spark, folder, S.RUN_INDEX)

    return S.index_gate(V.keep("index", spark, sf, build), 1, "src", "frz", "old/")


@query("csv_roundtrip", "S7 S8 S9", "SELECT run_id, repetition, a0, CASE WHEN repetition % 2 = 0 THEN n END AS n FROM rb", "a0")
def csv_roundtrip(spark, sf):
    """Frames of unequal columns written as one CSV and read back typed; NaN and blanks turn null."""

    def build():
        b = bounds(spark, sf)
        folder = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
        S.write_csv([b.where("repetition % 2 = 0").select("run_id", "repetition", "a0", "n"), b.where("repetition % 2 = 1").select("run_id", "repetition", "a0")], folder)
        return S.read_csv(spark, folder, "run_id string, repetition int, a0 double, n bigint")

    return V.keep("csv", spark, sf, build)


# --- artifact files --------------------------------------------------------------------------------


def run_folders(spark, sf):
    """Folders of run artifacts written from the run table: one JSON document and one table per campaign part."""

    def build():
        root = f"{checkpoint_dir(spark)}/artifacts-{uuid.uuid4().hex}"
        b = bounds(spark, sf)
        for name in ("requests.parquet", "system_metrics.parquet", "traces.parquet"):
            b.select(F.col("campaign_id").cast("string").alias("value"), F.concat(F.lit("c"), "campaign_id").alias("folder")).withColumn("value", F.concat(F.lit(name), F.col("value"))) \
                .distinct().write.partitionBy("folder").mode("append").text(f"{root}/{name}")
        return A.file_digests(spark, f"{root}/*/folder=*/*.txt").withColumns({
            "name": F.element_at(F.split("path", "/"), -3), "run_id": F.regexp_extract("path", r"folder=([^/]+)/", 1)})

    return V.keep("artifacts", spark, sf, build)


@query("artifact_footprint", "S12 A27", "SELECT 'c' || campaign_id AS run_id, CAST(16 + 22 + 14 + 3 * length(CAST(campaign_id AS VARCHAR)) + 3 AS BIGINT) AS total_bytes, CAST(22 + 14 + 2 * length(CAST(campaign_id AS VARCHAR)) + 2 AS BIGINT) AS optional_bytes FROM (SELECT DISTINCT campaign_id FROM req)")
def artifact_footprint(spark, sf):
    return A.footprint(run_folders(spark, sf)).select("run_id", "total_bytes", "optional_bytes")


@query("storage_projection", "A29")
def storage_projection(spark, sf):
    per = A.footprint(run_folders(spark, sf)).withColumn("label", F.lit("source"))
    return A.storage_projection(per, ["label"], 40.0)


@query("dq_missing_artifacts", "V1", "SELECT 'c' || campaign_id AS run_id, name AS subject, 'missing_artifact' AS code FROM (SELECT DISTINCT campaign_id FROM req), (SELECT unnest(['manifest.json', 'config.json', 'ground_truth.json', 'workload.json', 'runtime_metrics.parquet', 'events.jsonl', 'validation.json']) AS name)")
def dq_missing_artifacts(spark, sf):
    return A.missing_artifacts(run_folders(spark, sf))


@query("dq_manifest", "V4 V5 H1 H5", "SELECT 'c' || campaign_id AS run_id, subject, code FROM (SELECT DISTINCT campaign_id FROM req), (SELECT 'requests.parquet' AS subject, 'artifact_hash_mismatch' AS code UNION ALL SELECT 'traces.parquet', 'manifest_inventory_omission' UNION ALL SELECT 'events.jsonl', 'manifest_inventory_missing_file')")
def dq_manifest(spark, sf):
    files = run_folders(spark, sf)
    listed = files.where("name <> 'traces.parquet'").select("run_id", "name", F.when(F.col("name") == "requests.parquet", "0").otherwise(F.col("sha256")).alias("sha256"))
    absent = files.select("run_id").distinct().select("run_id", F.lit("events.jsonl").alias("name"), F.lit("0").alias("sha256"))
    return A.manifest_issues(files, listed.unionByName(absent))


@query("dq_documents", "S3 S4 V2", "SELECT DISTINCT CAST(campaign_id AS VARCHAR) AS subject, CASE WHEN campaign_id % 2 = 1 THEN 'corrupted_artifact' ELSE 'readable' END AS code FROM req")
def dq_documents(spark, sf):
    """Documents written one per campaign, half of them cut short, read permissively."""

    def build():
        folder = f"{checkpoint_dir(spark)}/documents-{uuid.uuid4().hex}"
        rows = bounds(spark, sf).groupBy("campaign_id").agg(F.count(F.lit(1)).alias("runs"), F.min("run_id").alias("first_run"))
        doc = S.sorted_json(rows.withColumn("id", F.col("campaign_id"))).withColumn("campaign", F.get_json_object("value", "$.id"))
        cut = doc.withColumn("value", F.when(F.col("campaign").cast("long") % 2 == 1, F.expr("substring(value, 1, 12)")).otherwise(F.col("value")))
        cut.repartition("campaign").write.partitionBy("campaign").text(folder)
        docs = S.read_documents(spark, f"{folder}/campaign=*/*.txt", "campaign_id bigint, runs bigint, first_run string")
        return docs.withColumn("campaign", F.regexp_extract("path", r"campaign=([^/]+)/", 1))

    docs = V.keep("documents", spark, sf, build)
    return docs.select(F.col("campaign").alias("subject"), F.when(F.col("_corrupt_record").isNotNull(), "corrupted_artifact").otherwise("readable").alias("code"))


@query("dq_config_hash", "V6 H7")
def dq_config_hash(spark, sf):
    conf = bounds(spark, sf).withColumn("config_hash", F.sha2(F.to_json(F.struct("a0", "condition_id", "n")), 256)).withColumns({
        "config_hash": F.when(F.col("repetition") == 1, "0").otherwise(F.col("config_hash"))})
    conf = conf.withColumn("manifest_config_hash", F.when(F.col("repetition") == 2, "1").otherwise(F.col("config_hash")))
    return A.config_hash_issues(conf, ["condition_id", "n", "a0"])


@query("tree_digest", "H7")
def tree_digest(spark, sf):
    return A.tree_digest(run_folders(spark, sf))


@query("fingerprint", "H2")
def fingerprint(spark, sf):
    return A.fingerprint(V.requests(spark, sf).select("request_id", "status", "actual_arrival", "completion_time")).withColumn("sum_hash", F.col("sum_hash").cast("string"))


@query("input_seal", "H3")
def input_seal(spark, sf):
    return A.seal({"requests": V.requests(spark, sf).select("request_id", "status"), "spans": V.spans(spark, sf).select("span_id", "duration"), "runs": bounds(spark, sf)})


@query("repeat_audit", "H4")
def repeat_audit(spark, sf):
    """The aggregate really runs twice; values are rounded before hashing, as sums may differ in the last bit."""
    from ..functions.core import round_doubles
    from ..operators.runs import compact_run_metrics

    once = lambda: round_doubles(compact_run_metrics(V.requests(spark, sf)))
    return A.repeat_audit(once(), once())


@query("registry_audit", "H6 J20", """SELECT run_id, key, matches, found, CASE WHEN matches = 1 AND abs(found - recorded) <= 1e-9 THEN 1 ELSE 0 END AS ok FROM (
  SELECT l.run_id, l.key, l.recorded, count(r.run_id) AS matches, CASE WHEN count(r.run_id) = 1 THEN max(r.ttft_p95) END AS found FROM (
    SELECT run_id, run_id || CASE WHEN repetition = 1 THEN '-x' ELSE '' END AS key, ttft_p95 + CASE WHEN repetition = 2 THEN 1 ELSE 0 END AS recorded FROM runs) l LEFT JOIN runs r ON r.run_id = l.key GROUP BY ALL)""", "found")
def registry_audit(spark, sf):
    runs = V.runs(spark, sf)
    lookups = runs.select("run_id", F.concat("run_id", F.when(F.col("repetition") == 1, "-x").otherwise("")).alias("key"), (F.col("ttft_p95") + F.when(F.col("repetition") == 2, 1).otherwise(0)).alias("recorded"))
    out = J.exactly_one(runs.select(F.col("run_id").alias("key"), "ttft_p95"), lookups, ["key"], "ttft_p95")
    good = (F.col("matches") == 1) & (F.abs(F.col("found") - F.col("recorded")) <= 1e-9)
    return out.select("run_id", "key", "matches", "found", F.coalesce(good, F.lit(False)).cast("int").alias("ok"))


# --- logs ------------------------------------------------------------------------------------------


def scrapes(df):
    """One scrape body per event: a comment, two samples, a malformed line; every seventh is JSON-quoted."""
    name = F.concat(F.lit("requests_total{type=\""), F.col("event_type"), F.lit("\"} "), F.col("event_id").cast("string"))
    body = F.concat(F.lit("# HELP x\n"), name, F.lit("\nlatency_seconds "), F.col("value").cast("string"), F.lit("\nbroken line here\n"))
    plain = F.concat(F.lit("latency_seconds "), F.col("value").cast("string"))
    quoted = F.concat(F.lit('"'), plain, F.lit('\\nqueue_depth 3"'))
    return df.select("event_id", F.when(F.col("event_id") % 7 == 0, quoted).otherwise(body).alias("body"))


_LOGS = """SELECT event_id, 'requests_total' AS metric_name, event_id::DOUBLE AS metric_value, 'type="' || event_type || '"' AS labels FROM events WHERE event_id % 7 <> 0
  UNION ALL SELECT event_id, 'latency_seconds', value, '' FROM events UNION ALL SELECT event_id, 'queue_depth', 3, '' FROM events WHERE event_id % 7 = 0"""


@query("metric_log_parse", "S13", _LOGS, "metric_value")
def metric_log_parse(spark, sf):
    return LG.metric_rows(scrapes(V.events(spark, sf)))


def chunk_lines(df):
    e = F.col("event_id")
    data = lambda body: F.concat(F.lit("data: "), body)
    text = F.concat(F.lit('{"choices":[{"text":"'), F.col("event_type"), F.lit('"}]}'))
    delta = F.lit('{"choices":[{"delta":{"content":"x"},"finish_reason":"stop"}]}')
    usage = F.concat(F.lit('{"choices":[],"timings":{"prompt_n":'), (e % 100).cast("string"), F.lit(',"predicted_n":7,"prompt_ms":'), (e % 50).cast("string"), F.lit(',"predicted_ms":250}}'))
    lines = F.array(*[F.struct((e + F.lit(i * 0.25)).alias("ts"), line.alias("line")) for i, line in enumerate((
        F.lit(": ping"), data(F.lit('{"choices":[{"text":""}]}')), data(text), data(delta), F.lit(""), data(usage), F.lit("data: [DONE]")))])
    return df.select("event_id", F.explode(lines).alias("l")).select("event_id", "l.*")


@query("token_stream_timing", "S14", """SELECT event_id, event_id + 0.5::DOUBLE AS first_token_time, event_id + 1.5::DOUBLE AS completion_time, 'stop' AS finish_reason, event_id % 100 AS server_prompt_tokens, 7 AS server_output_tokens,
  (event_id % 50) / 1e3 AS server_prompt_seconds, 0.25::DOUBLE AS server_generation_seconds, 2 AS content_chunks, 1 AS saw_end FROM events""", "first_token_time completion_time server_prompt_seconds server_generation_seconds")
def token_stream_timing(spark, sf):
    return LG.stream_timing(chunk_lines(V.events(spark, sf)), ["event_id"])


# --- streams ---------------------------------------------------------------------------------------


def event_stream(spark, sf):
    schema = V.events(spark, sf).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def request_stream(spark, sf):
    return requests_from(event_stream(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp"))


LIMIT = 0.26779416389490324


@query("stream_slo_windows", "X1", f"""SELECT epoch_us(w) AS window_us, campaign_id, n AS requests, violations, max_latency, p95_latency FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, campaign_id, count(*) AS n, count(*) FILTER (WHERE total_latency > {LIMIT!r}::DOUBLE) AS violations, max(total_latency) AS max_latency, quantile_disc(total_latency, 0.95) AS p95_latency FROM lat GROUP BY ALL)
  WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""", "max_latency p95_latency")
def stream_slo_windows(spark, sf):
    out = M.run_available(M.slo_windows(request_stream(spark, sf), "ts", ["campaign_id"], LIMIT))
    return out.select(F.unix_micros("window_start").alias("window_us"), "campaign_id", "requests", "violations", "max_latency", "p95_latency")


@query("stream_dedup", "X2", "SELECT request_id, event_id FROM req")
def stream_dedup(spark, sf):
    twice = request_stream(spark, sf).select("request_id", "event_id", "ts").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return M.run_available(M.deduplicate(twice, "ts", ["request_id"])).drop("ts")


@query("stream_reconcile", "X3", """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS resolved FROM events WHERE event_id % 3 <> 0 OR ts < (SELECT max(ts) FROM events WHERE event_id % 3 <> 0) - INTERVAL 10 MINUTE""")
def stream_reconcile(spark, sf):
    left = event_stream(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    right = event_stream(spark, sf).where("event_id % 3 <> 0").select("event_id", (F.col("ts").cast("timestamp") + F.expr("interval 200 milliseconds")).alias("timing_ts"))
    return M.run_available(M.late_timing(left, right, "event_id", "ts", "timing_ts")).select("event_id", "resolved")


@query("stream_lifecycle", "X4", """SELECT run_id, CAST(event_seq AS VARCHAR) AS subject, 'event_time_not_monotonic' AS code FROM (SELECT *, lag(monotonic_time) OVER (PARTITION BY run_id ORDER BY event_seq) AS b FROM revt) WHERE monotonic_time < b
  UNION ALL SELECT run_id, prev || '>' || state, 'illegal_lifecycle_transition' FROM (SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY event_seq) AS prev FROM revt WHERE event_type = 'state') WHERE prev IS NOT NULL AND prev || '>' || state NOT IN ("""
       + ", ".join(f"'{a}>{b}'" for a, bs in Q.TRANSITIONS.items() for b in bs) + ")")
def stream_lifecycle(spark, sf):
    """Ordered by number whatever the triggers; a heartbeat in the far future lets the watermark pass all events."""
    folder = f"{checkpoint_dir(spark)}/events-{uuid.uuid4().hex}"
    timed = run_events(spark, sf).withColumn("event_time", F.expr(CLOCK.replace("{at}", "monotonic_time")))
    beat = timed.groupBy().agg(F.max("event_time").alias("event_time")).select(
        F.lit(-1).cast("long").alias("campaign_id"), F.lit("heartbeat").alias("run_id"), F.lit(0).alias("event_seq"), F.lit("heartbeat").alias("event_type"), F.lit(None).cast("string").alias("state"),
        F.lit(0.0).alias("monotonic_time"), (F.col("event_time") + F.expr("interval 1 day")).alias("event_time"))
    rows = timed.select(beat.columns).unionByName(beat)
    rows.write.parquet(folder)
    return M.run_available(ST.lifecycle(spark.readStream.schema(rows.schema).parquet(folder), held_by=["campaign_id"]))


#: One clock for all campaigns: a day for each, and the seconds of the campaign's own time, which may be a little below zero.
CLOCK = "timestamp_micros(cast((campaign_id + 1) * 86400000000 as bigint) + cast(round({at} * 1000000) as bigint))"


@query(
    "stream_inflight", "X7",
    f"""WITH s AS (SELECT campaign_id, condition_id, repetition, run_id, request_id, actual_arrival AS sec, 1 AS step FROM req WHERE actual_arrival IS NOT NULL AND completion_time IS NOT NULL
        UNION ALL SELECT campaign_id, condition_id, repetition, run_id, request_id, completion_time, -1 FROM req WHERE actual_arrival IS NOT NULL AND completion_time IS NOT NULL),
      t AS (SELECT *, (campaign_id + 1) * 86400000000 + CAST(round(sec * 1000000) AS BIGINT) AS us FROM s),
      g AS (SELECT *, CAST(sum(step) OVER (PARTITION BY run_id ORDER BY us, step, request_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS outstanding FROM t)
    SELECT campaign_id, condition_id, repetition, run_id, request_id, sec AS arrival_time, outstanding, CASE WHEN outstanding > 8 THEN 1 ELSE 0 END AS breach
    FROM g WHERE step = 1 AND (us // 10000000 + 1) * 10000000 <= (SELECT max(us) FROM t) - 60000000""",
    "arrival_time",
)
def stream_inflight(spark, sf):
    """The gauge of the batch query kept by a stream: arrivals the watermark has passed."""
    clock = CLOCK.replace("{at}", "at")
    return M.run_available(ST.in_flight(ST.moves(requests_from(event_stream(spark, sf)), clock, RUN), RUN, cap=8, held_by=["campaign_id"])).withColumnRenamed("at", "arrival_time")


@query("stream_drift", "X5", """SELECT r.request_id, r.dependency_duration FROM req r JOIN mech m USING (run_id) WHERE m.verification_state = 'STOPPED' AND r.actual_arrival >= m.actual_onset AND r.actual_arrival <= m.actual_stop AND abs(r.dependency_duration - 0.1::DOUBLE) > 0.01::DOUBLE""", "dependency_duration")
def stream_drift(spark, sf):
    w = mechanisms(spark, sf).where("verification_state = 'STOPPED'").select(*RUN, F.col("actual_onset").alias("active_from"), F.col("actual_stop").alias("active_to"), F.lit(0.1).alias("expected"))
    return M.run_available(M.drift(request_stream(spark, sf), w, RUN, "dependency_duration", 0.01).select("request_id", "dependency_duration"))


@query("stream_metrics", "X6", "SELECT metric_name, metric_value, labels FROM (" + _LOGS + ")", "metric_value")
def stream_metrics(spark, sf):
    """A scrape log written as text and read as a text stream, line by line."""
    folder = f"{checkpoint_dir(spark)}/scrapes-{uuid.uuid4().hex}"
    scrapes(V.events(spark, sf)).select(F.col("body").alias("value")).write.text(folder)
    return M.run_available(LG.metric_rows(spark.readStream.text(folder), "value"))


@query("stream_counters", "X8", "SELECT event_id, 'accepted_requests_total' AS counter, event_id AS value FROM events UNION ALL SELECT event_id, 'failed_requests_total', user_id FROM events")
def stream_counters(spark, sf):
    packed = F.concat(F.lit("accepted_requests_total="), F.col("event_id").cast("string"), F.lit(";failed_requests_total="), F.col("user_id").cast("string"))
    return M.run_available(LG.counter_values(event_stream(spark, sf).select("event_id", packed.alias("counters")), ["event_id"]))
