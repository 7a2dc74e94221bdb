"""Experiment design: conditions, factorial cells, blocked order, gates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import portable_uniform

# Causes in their reporting order and the mechanism label behind each.
CAUSES = ["INPUT", "OUTPUT", "LOAD", "DOWNSTREAM"]
CAUSE_LABELS = {"INPUT": "input_medium", "OUTPUT": "output_32", "LOAD": "load_12rps", "DOWNSTREAM": "downstream_100ms"}
CAUSE_SETS = [(), *[(c,) for c in CAUSES], *combinations(CAUSES, 2)]

SMALL, MEDIUM, CONTINUATION = "synthetic-input-small", "synthetic-input-medium", "synthetic-continuation"


def _condition(cid, family, mechanisms, control, profile, tokens, gap, delay=0):
    return {
        "condition_id": cid, "mechanism_family": family, "active_mechanisms": list(mechanisms),
        "mechanism_levels": {m: "medium" for m in mechanisms}, "compound_degree": len(mechanisms),
        "expected_control_id": control, "prompt_profile": profile, "target_output_tokens": tokens,
        "inter_arrival_seconds": gap, "max_outstanding_requests": 64, "dependency_delay_ms": delay,
    }


# The thirteen conditions of a campaign.
CONDITIONS = [
    _condition("BASELINE", "control", [], None, SMALL, 16, 0.25),
    _condition("OUTPUT_CONTROL", "control", [], None, CONTINUATION, 16, 0.5),
    _condition("OUTPUT_LOAD_CONTROL", "control", ["load_12rps"], "OUTPUT_CONTROL", CONTINUATION, 16, 1 / 12),
    _condition("OUTPUT_DOWNSTREAM_CONTROL", "control", ["downstream_100ms"], "OUTPUT_CONTROL", CONTINUATION, 16, 0.5, 100),
    _condition("INPUT_MEDIUM", "input", ["input_medium"], "BASELINE", MEDIUM, 16, 0.25),
    _condition("OUTPUT_MEDIUM", "output", ["output_32"], "OUTPUT_CONTROL", CONTINUATION, 32, 0.5),
    _condition("LOAD_MEDIUM", "load", ["load_12rps"], "BASELINE", SMALL, 16, 1 / 12),
    _condition("DOWNSTREAM_MEDIUM", "downstream", ["downstream_100ms"], "BASELINE", SMALL, 16, 0.25, 100),
    _condition("INPUT_LOAD", "compound", ["input_medium", "load_12rps"], "BASELINE", MEDIUM, 16, 1 / 12),
    _condition("INPUT_DOWNSTREAM", "compound", ["input_medium", "downstream_100ms"], "BASELINE", MEDIUM, 16, 0.25, 100),
    _condition("OUTPUT_LOAD", "compound", ["output_32", "load_12rps"], "OUTPUT_CONTROL", CONTINUATION, 32, 1 / 12),
    _condition("OUTPUT_DOWNSTREAM", "compound", ["output_32", "downstream_100ms"], "OUTPUT_CONTROL", CONTINUATION, 32, 0.5, 100),
    _condition("LOAD_DOWNSTREAM", "compound", ["load_12rps", "downstream_100ms"], "BASELINE", SMALL, 16, 1 / 12, 100),
]
CONTROLS = ["BASELINE", "OUTPUT_CONTROL"]
LOAD_CONDITIONS = ["LOAD_MEDIUM", "INPUT_LOAD", "OUTPUT_LOAD", "LOAD_DOWNSTREAM"]

# Which condition fills each cell of the five 2x2 designs (A0B0, A1B0, A0B1, A1B1).
CELLS = ["A0B0", "A1B0", "A0B1", "A1B1"]
FACTORIAL = {
    "INPUT_LOAD": ["BASELINE", "INPUT_MEDIUM", "LOAD_MEDIUM", "INPUT_LOAD"],
    "INPUT_DOWNSTREAM": ["BASELINE", "INPUT_MEDIUM", "DOWNSTREAM_MEDIUM", "INPUT_DOWNSTREAM"],
    "OUTPUT_LOAD": ["OUTPUT_CONTROL", "OUTPUT_MEDIUM", "OUTPUT_LOAD_CONTROL", "OUTPUT_LOAD"],
    "OUTPUT_DOWNSTREAM": ["OUTPUT_CONTROL", "OUTPUT_MEDIUM", "OUTPUT_DOWNSTREAM_CONTROL", "OUTPUT_DOWNSTREAM"],
    "LOAD_DOWNSTREAM": ["BASELINE", "LOAD_MEDIUM", "DOWNSTREAM_MEDIUM", "LOAD_DOWNSTREAM"],
}

# Matched comparisons (mechanism, condition, control, primary metric, direct metric).
COMPARISONS = [
    ("INPUT", "INPUT_MEDIUM", "BASELINE", "ttft_p95", "server_prompt_tokens_median"),
    ("OUTPUT", "OUTPUT_MEDIUM", "OUTPUT_CONTROL", "post_first_token_duration_p95", "server_output_tokens_median"),
    ("LOAD", "LOAD_MEDIUM", "BASELINE", "ttft_p95", "requests_deferred_max"),
    ("DOWNSTREAM", "DOWNSTREAM_MEDIUM", "BASELINE", "ttft_p95", "dependency_duration_median"),
]


def conditions(spark: SparkSession) -> DataFrame:
    schema = (
        "condition_id string, mechanism_family string, active_mechanisms array<string>, "
        "mechanism_levels map<string,string>, compound_degree int, expected_control_id string, prompt_profile string, "
        "target_output_tokens int, inter_arrival_seconds double, max_outstanding_requests int, dependency_delay_ms int"
    )
    return spark.createDataFrame(CONDITIONS, schema)


def factorial_cells(spark: SparkSession) -> DataFrame:
    rows = [(comp, cell, cond) for comp, conds in FACTORIAL.items() for cell, cond in zip(CELLS, conds)]
    return spark.createDataFrame(rows, "compound string, cell string, condition_id string")


def comparisons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        COMPARISONS, "mechanism string, condition string, control string, primary_metric string, direct_metric string"
    )


def blocked_order(rows: DataFrame, block: list[str], item: str, seed: int) -> DataFrame:
    """Shuffle the items inside each block by a portable hash and number them through the block."""
    u = portable_uniform(seed, *[F.col(b) for b in block], F.col(item))
    within = Window.partitionBy(*block).orderBy("_u", item)
    return rows.withColumn("_u", u).withColumn("block_order", F.row_number().over(within)).drop("_u")


def campaign_order(rows: DataFrame, seed: int) -> DataFrame:
    """Blocked order per repetition, then one running order over the repetitions of a campaign.

    The start of each block is the size of the earlier blocks, so no whole campaign is sorted.
    """
    ordered = blocked_order(rows, ["campaign_id", "repetition"], "condition_id", seed)
    sizes = rows.groupBy("campaign_id", "repetition").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("campaign_id").orderBy("repetition").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("campaign_id", "repetition", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ordered.join(starts, ["campaign_id", "repetition"]).withColumn(
        "campaign_order", F.col("_start") + F.col("block_order")
    ).drop("_start")


def reference_level(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest clean, controllable and effective candidate per group."""
    usable = (
        ~F.col("queue_confounded") & (F.coalesce("token_realization_floor", F.lit(0.0)) >= 0.90)
        & (F.coalesce("effect_ratio", F.lit(0.0)) > 1.05)
    )
    return rows.groupBy(*keys).agg(F.min_by(F.when(usable, F.col("candidate")), F.when(usable, F.col("level"))).alias("reference_candidate"))


def context_gate(rows: DataFrame, keys: list[str], limit: int = 1024, margin: int = 64, reserve: int = 16) -> DataFrame:
    """Whether every row leaves room in the context and realises its token target."""
    fits = F.col("prompt_tokens") + F.lit(reserve) + F.lit(margin) < F.lit(limit)
    controllable = F.col("output_fraction") >= 0.90
    return rows.groupBy(*keys).agg(
        F.bool_and(F.coalesce(fits, F.lit(False))).alias("context_safe"),
        F.bool_and(F.coalesce(controllable, F.lit(False))).alias("output_controllable"),
    )


def workload_plan(workloads: DataFrame, prompt_pool: int = 8) -> DataFrame:
    """Expand each workload row to one row per planned request."""
    seq = F.col("sequence")
    arrival: Column = (
        F.when(F.col("arrival_pattern") == "constant_open_loop", F.col("start_offset_seconds") + seq * F.col("inter_arrival_seconds"))
        .when(F.col("arrival_pattern") == "burst", F.col("start_offset_seconds") + F.floor(seq / F.col("burst_size")) * F.col("burst_interval_seconds"))
        .when(F.col("arrival_pattern") == "batched_arrival", F.col("start_offset_seconds") + F.floor(seq / F.col("concurrency")) * F.col("inter_arrival_seconds"))
    )
    jitter = F.floor(portable_uniform(F.col("seed"), F.col("run_id"), seq) * (2 * F.col("output_jitter_tokens") + 1)) - F.col("output_jitter_tokens")
    target = F.when(F.col("output_jitter_tokens") > 0, F.greatest(F.lit(1), F.col("target_output_tokens") + jitter)).otherwise(F.col("target_output_tokens"))
    planned = workloads.where("request_count > 0").withColumn("sequence", F.explode(F.sequence(F.lit(0), F.col("request_count").cast("int") - 1)))
    return planned.select(
        *[c for c in ["campaign_id", "condition_id", "repetition", "run_id"] if c in workloads.columns],
        F.concat(F.col("run_id"), F.lit("-req-"), F.lpad(seq.cast("string"), 6, "0")).alias("request_id"),
        seq.cast("bigint").alias("sequence"),
        F.bround(arrival, 9).alias("scheduled_arrival"),
        F.col("prompt_profile"),
        F.concat(F.col("prompt_profile"), F.lit("-"), (seq % prompt_pool).cast("string")).alias("prompt_id"),
        target.cast("bigint").alias("target_output_tokens"),
    )
