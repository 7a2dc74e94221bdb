"""Readers and writers of run artifacts: declared schemas, one glob per table over all runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _L, _S = "double", "bigint", "string"


def _schema(columns: Sequence[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(n, {"double": T.DoubleType(), "bigint": T.LongType(), "string": T.StringType()}[t]) for n, t in columns])


# The declared columns of the four telemetry tables.
REQUESTS = _schema([
    ("request_id", _S), ("sequence", _L), ("scheduled_arrival", _D), ("actual_arrival", _D), ("dispatch_time", _D), ("first_token_time", _D),
    ("completion_time", _D), ("prompt_tokens", _L), ("output_tokens", _L), ("status", _S), ("runtime_id", _S), ("model_id", _S),
    ("http_status", _L), ("error_type", _S), ("error_message", _S), ("server_prompt_tokens", _L), ("server_output_tokens", _L),
    ("server_prompt_seconds", _D), ("server_generation_seconds", _D), ("finish_reason", _S), ("scheduler_slip", _D), ("token_count_source", _S),
    ("gateway_receive_time", _D), ("dependency_start_time", _D), ("dependency_end_time", _D), ("llama_dispatch_time", _D),
    ("llama_first_token_time", _D), ("gateway_completion_time", _D), ("dependency_duration", _D),
])
SYSTEM_METRICS = _schema(
    [(n, _D) for n in (
        "timestamp", "host_cpu", "process_cpu", "memory", "memory_pressure", "disk_io", "network", "process_rss", "memory_used", "memory_available",
        "host_cpu_percent", "host_memory_percent", "host_memory_used_bytes", "host_memory_available_bytes", "client_process_cpu_percent", "client_process_rss_bytes")]
    + [c for r in ("server", "gateway", "dependency") for c in ((f"{r}_pid", _L), (f"{r}_process_cpu_percent", _D), (f"{r}_process_rss_bytes", _D))]
)
RUNTIME_METRICS = _schema([
    ("timestamp", _D), ("runtime_id", _S), ("queue_depth", _L), ("active_requests", _L), ("deferred_requests", _L), ("throughput", _D),
    ("counters", _S), ("metric_name", _S), ("metric_value", _D), ("labels", _S),
])
SPANS = _schema([
    ("trace_id", _S), ("span_id", _S), ("parent_span_id", _S), ("span_name", _S), ("start_time", _D), ("end_time", _D), ("duration", _D),
    ("status", _S), ("attributes", _S),
])
TABLES = {"requests": REQUESTS, "system_metrics": SYSTEM_METRICS, "runtime_metrics": RUNTIME_METRICS, "traces": SPANS}
# The document schemas are DDL text, so importing this module needs no session.
EVENTS = "event_type string, state string, monotonic_time double, wall_time string, message string, details string"
RUN_INDEX = (
    "run_id string, run_path string, condition_id string, repetition int, source_hash string, freeze_hash string, "
    "artifact_manifest_hash string, publication_analysis_eligible boolean")
CONDITION = (
    "campaign_id string, campaign_condition_id string, condition_id string, mechanism_family string, active_mechanisms array<string>, "
    "mechanism_levels map<string,string>, compound_degree int, expected_control_id string, repetition int, attempt int, run_id string")


def run_of(path) -> "F.Column":
    """Run folder name of a file path."""
    return F.element_at(F.split(path, "/"), -2)


def read_table(spark: SparkSession, root: str, name: str, index: DataFrame | None = None) -> DataFrame:
    """One telemetry table of every run under ``root``, tagged by run; optionally only indexed runs."""
    df = spark.read.schema(TABLES[name]).parquet(f"{root}/*/{name}.parquet").select("*", run_of(F.col("_metadata.file_path")).alias("run_id"))
    return df.join(index.select("run_id"), "run_id", "left_semi") if index is not None else df


def project(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows onto a declared schema: absent columns become null, others are cast."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def write_table(df: DataFrame, path: str, schema: T.StructType) -> None:
    allowed = (T.StringType, T.LongType, T.DoubleType)
    bad = [f.name for f in schema if not isinstance(f.dataType, allowed)]
    if bad:
        raise ValueError(f"unsupported column types: {bad}")
    project(df, schema).write.parquet(path)


def _struct(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_documents(spark: SparkSession, paths: str, schema: T.StructType | str) -> DataFrame:
    """One pretty-printed JSON object per file. Unreadable files keep a row with their text."""
    schema = _struct(schema)
    tagged = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(tagged).json(paths)
    names = [f.name for f in schema.fields if f.name != "run_id"]
    return raw.select(*names, "_corrupt_record", F.col("_metadata.file_path").alias("path"), run_of(F.col("_metadata.file_path")).alias("run_id"))


def sorted_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object with sorted keys; nested dictionaries keep their own order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_documents(df: DataFrame, path: str) -> None:
    sorted_json(df).write.text(path)


def read_jsonl(spark: SparkSession, paths: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines carry nothing and are skipped."""
    return spark.read.schema(schema).json(paths)


def write_jsonl(df: DataFrame, path: str) -> None:
    sorted_json(df).write.text(path)


_CSV_TYPES = {"int64": "bigint", "int": "bigint", "float64": "double", "float": "double", "double": "double", "bool": "boolean", "string": "string", "str": "string"}


def read_typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose first line names columns and whose second gives their types; empty cells are null.

    Only the two header lines reach the driver.
    """
    head = [r.value for r in spark.read.text(path).limit(2).collect()]
    names, kinds = head[0].split(","), head[1].split(",")
    raw = spark.read.option("header", True).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    kind_row = F.lit(True)
    for n, k in zip(names, kinds):
        kind_row = kind_row & (F.col(n) == k)
    rows = raw.where(~F.coalesce(kind_row, F.lit(False)))
    blank = lambda n: F.when(F.trim(F.col(n)) != "", F.trim(F.col(n)))
    return rows.select(*[blank(n).try_cast(_CSV_TYPES.get(k.strip(), "string")).alias(n) for n, k in zip(names, kinds)])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Header CSV with declared types; NaN becomes null."""
    schema = _struct(schema)
    df = spark.read.option("header", True).schema(schema).csv(path)
    return df.select(*[F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in schema])


def union_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of unequal columns stacked; the header is the first-seen order."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_csv(frames: Sequence[DataFrame], path: str) -> None:
    union_columns(frames).write.option("header", True).csv(path)


def index_gate(index: DataFrame, expected: int, source_hash: str, freeze_hash: str, superseded_prefix: str) -> DataFrame:
    """Index rows that fail a gate, with the reason; plus one row when the count is off."""
    reasons = F.array_compact(F.array(
        F.when(~F.coalesce("publication_analysis_eligible", F.lit(False)), "not_eligible"), F.when(~F.col("source_hash").eqNullSafe(source_hash), "source_hash"),
        F.when(~F.col("freeze_hash").eqNullSafe(freeze_hash), "freeze_hash"), F.when(F.startswith("run_path", F.lit(superseded_prefix)), "superseded_path")))
    rows = index.select("run_id", F.explode(reasons).alias("reason"))
    twice = index.groupBy("run_id").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("run_id", F.lit("duplicate_run_id").alias("reason"))
    total = index.agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") != expected).select(F.lit("*").alias("run_id"), F.lit("row_count").alias("reason"))
    return rows.unionByName(twice).unionByName(total)
