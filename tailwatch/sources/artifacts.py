"""Files of run folders as data: sizes, digests, presence, manifests, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .telemetry import run_of

# Files every run folder must hold, and the optional telemetry files.
REQUIRED = [
    "manifest.json", "config.json", "ground_truth.json", "workload.json", "requests.parquet", "system_metrics.parquet",
    "runtime_metrics.parquet", "traces.parquet", "events.jsonl", "validation.json",
]
OPTIONAL = ["system_metrics.parquet", "runtime_metrics.parquet", "traces.parquet"]


def file_inventory(spark: SparkSession, glob: str) -> DataFrame:
    """Path and size of every file; the content column is pruned, so no byte is read."""
    df = spark.read.format("binaryFile").load(glob).select("path", "length")
    return df.withColumns({"name": F.element_at(F.split("path", "/"), -1), "run_id": run_of(F.col("path"))})


def file_digests(spark: SparkSession, glob: str) -> DataFrame:
    df = spark.read.format("binaryFile").load(glob)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), run_of(F.col("path")).alias("run_id"), "length", F.sha2("content", 256).alias("sha256"))


def footprint(inventory: DataFrame) -> DataFrame:
    """Bytes per run: total, optional telemetry, and each optional table."""
    of = lambda n: F.coalesce(F.sum(F.when(F.col("name") == n, F.col("length"))), F.lit(0))
    return inventory.groupBy("run_id").agg(
        F.sum("length").alias("total_bytes"), F.sum(F.when(F.col("name").isin(*OPTIONAL), F.col("length")).otherwise(0)).alias("optional_bytes"),
        of(OPTIONAL[0]).alias("system_bytes"), of(OPTIONAL[1]).alias("runtime_bytes"), of(OPTIONAL[2]).alias("trace_bytes"))


def storage_projection(per_run: DataFrame, keys: Sequence[str], requests_per_run: float) -> DataFrame:
    return per_run.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("system_bytes").alias("system_bytes_per_run"), (F.avg("system_bytes") / requests_per_run).alias("system_bytes_per_request"),
        F.sum("system_bytes").alias("total_system_bytes"), (F.sum("system_bytes") / F.nullif(F.sum("optional_bytes"), F.lit(0))).alias("system_share_of_optional"),
        F.avg("trace_bytes").alias("trace_bytes_per_run"), (F.avg("trace_bytes") / requests_per_run).alias("trace_bytes_per_request"))


def missing_artifacts(inventory: DataFrame, required: Sequence[str] = tuple(REQUIRED)) -> DataFrame:
    """Required files absent from each run folder, by conditional counts: no expected table is built."""
    per = inventory.groupBy("run_id").agg(*[F.count_if(F.col("name") == n).alias(f"_{i}") for i, n in enumerate(required)])
    gone = F.array_compact(F.array(*[F.when(F.col(f"_{i}") == 0, F.lit(n)) for i, n in enumerate(required)]))
    return per.select("run_id", F.explode(gone).alias("subject"), F.lit("missing_artifact").alias("code"))


def corrupt_documents(documents: DataFrame) -> DataFrame:
    # Spark refuses to answer from the corrupt column alone, so the reader's other columns stay in the plan.
    return documents.where(F.col("_corrupt_record").isNotNull()).select("run_id", F.col("path").alias("subject"), F.lit("corrupted_artifact").alias("code"))


def manifest_issues(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed but absent, present but unlisted, wrong digest, no digest. ``manifest`` is long:
    ``(run_id, name, sha256)``; ``inventory`` has digests."""
    m = manifest.select("run_id", "name", F.col("sha256").alias("_want"), F.lit(1).alias("_m"))
    f = inventory.select("run_id", "name", F.col("sha256").alias("_have"), F.lit(1).alias("_f"))
    both = m.join(f, ["run_id", "name"], "full_outer")
    code = (
        F.when(F.col("_f").isNull(), "manifest_inventory_missing_file").when(F.col("_m").isNull(), "manifest_inventory_omission")
        .when(F.col("_want").isNull(), "missing_hash").when(F.col("_want") != F.col("_have"), "artifact_hash_mismatch"))
    return both.withColumn("code", code).where("code is not null").select("run_id", F.col("name").alias("subject"), "code")


def config_hash_issues(configs: DataFrame, canonical: Sequence[str]) -> DataFrame:
    """Recorded configuration digest against the digest of its canonical form, and the manifest's copy."""
    digest = F.sha2(F.to_json(F.struct(*sorted(canonical))), 256)
    code = F.array_compact(F.array(
        F.when(~F.col("config_hash").eqNullSafe(digest), "config_hash_mismatch"), F.when(~F.col("manifest_config_hash").eqNullSafe(F.col("config_hash")), "manifest_config_hash_mismatch")))
    return configs.select("run_id", F.explode(code).alias("code"))


def row_digest(columns: Sequence[str]) -> "F.Column":
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-insensitive digest of a table: row count, xor and sum of row hashes. Fully combinable."""
    h = F.xxhash64(row_digest(columns or df.columns))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(38,0)")).alias("sum_hash"))


def seal(parts: dict[str, DataFrame]) -> DataFrame:
    """Named fingerprints with one digest over them all, in name order."""
    rows = None
    for name, df in sorted(parts.items()):
        f = fingerprint(df).select(F.lit(name).alias("name"), F.sha2(F.concat_ws("|", "rows", "xor_hash", "sum_hash"), 256).alias("digest"))
        rows = f if rows is None else rows.unionByName(f)
    whole = rows.agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws("=", "name", "digest")))), 256).alias("digest")).select(F.lit("*").alias("name"), "digest")
    return rows.unionByName(whole)


def repeat_audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two executions compared by fingerprint."""
    a, b = fingerprint(first), fingerprint(second)
    left = a.select(F.struct("rows", "xor_hash", "sum_hash").alias("first"), F.lit(1).alias("_k"))
    right = b.select(F.struct("rows", "xor_hash", "sum_hash").alias("second"), F.lit(1).alias("_k"))
    return left.join(right, "_k").select(
        F.col("first.rows").alias("rows"), F.col("first.xor_hash").alias("xor_hash"), (F.col("first") == F.col("second")).cast("int").alias("identical"))


def tree_digest(digests: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Digest of each folder: its files' digests, with lengths, joined in path order.

    Folders hold tens of files. The value differs from a digest streamed over the bytes.
    """
    part = F.concat_ws(":", F.length("name").cast("string"), "name", F.col("length").cast("string"), "sha256")
    return digests.groupBy(*keys).agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(part))), 256).alias("tree_digest"), F.count(F.lit(1)).alias("files"))
