"""Pairing runs with controls, reconciling late timing, and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import safe_ratio
from .ordered import with_neighbours

GATEWAY_FIELDS = [
    "gateway_receive_time", "dependency_start_time", "dependency_end_time", "llama_dispatch_time",
    "llama_first_token_time", "gateway_completion_time", "dependency_duration",
]


def nearest_control(runs: DataFrame, keys: Sequence[str], order: str, is_control: Column, metrics: Sequence[str],
                    hot_rows: int | None = None) -> DataFrame:
    """Each run beside the control nearest in running order; ties go to the earlier control.

    Two carried values per row decide it, so the cost is linear and nothing is joined.
    """
    out = with_neighbours(runs, keys, [order], is_control, [order, "run_id", *metrics], "_prev", "_next", hot_rows)
    ahead, behind = F.col("_next")[order] - F.col(order), F.col(order) - F.col("_prev")[order]
    pick = F.when(F.col("_prev").isNull() | (ahead < behind), F.col("_next")).otherwise(F.col("_prev"))
    out = out.withColumn("_c", F.when(~is_control, pick))
    return out.withColumns({
        "paired_control_run_id": F.col("_c")["run_id"], **{f"{m}_ratio": safe_ratio(F.col(m), F.col("_c")[m]) for m in metrics},
    }).drop("_prev", "_next", "_c")


def block_control(runs: DataFrame, block: Sequence[str], is_control: Column, metrics: Sequence[str]) -> DataFrame:
    """Each run beside the valid control of its block. Blocks hold one control, so rows stay unique."""
    control = runs.where(is_control).groupBy(*block).agg(F.max_by(F.struct("run_id", *metrics), "run_id").alias("_c"))
    out = runs.join(control, list(block), "left")
    return out.withColumns({
        "paired_control_run_id": F.when(~is_control, F.col("_c.run_id")),
        **{f"{m}_ratio": F.when(~is_control, safe_ratio(F.col(m), F.col(f"_c.{m}"))) for m in metrics},
    }).drop("_c")


def family_control(runs: DataFrame, design: DataFrame, block: Sequence[str], metrics: Sequence[str], valid: Column) -> DataFrame:
    """Each run beside the valid control its condition names, in the same block; controls pair with none."""
    named = runs.join(F.broadcast(design.select("condition_id", "expected_control_id")), "condition_id", "left")
    control = runs.where(valid).select(*block, F.col("condition_id").alias("expected_control_id"), F.struct("run_id", *metrics).alias("_c"))
    out = named.join(control, [*block, "expected_control_id"], "left")
    return out.withColumns({
        "paired_control_run_id": F.col("_c.run_id"), **{f"{m}_ratio": safe_ratio(F.col(m), F.col(f"_c.{m}")) for m in metrics},
    }).drop("_c")


def _complete(fields: Sequence[str], prefix: str = "") -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f"{prefix}{f}").isNotNull()
    return out


def reconcile_timings(requests: DataFrame, timings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fill gateway timing of successful requests that lack some, and only from a complete record.

    Joins on (run, request), so a hot run is spread. ``resolution`` tells what happened to each row.
    """
    late = timings.where(_complete(GATEWAY_FIELDS)).select(*keys, "request_id", *[F.col(f).alias(f"_late_{f}") for f in GATEWAY_FIELDS])
    needs = (F.col("status") == "success") & ~_complete(GATEWAY_FIELDS)
    out = requests.withColumn("_needs", needs).join(late, [*keys, "request_id"], "left")
    found = F.col("_needs") & F.col(f"_late_{GATEWAY_FIELDS[0]}").isNotNull()
    out = out.withColumn("resolution", F.when(~F.col("_needs"), "not_required").when(found, "resolved").otherwise("unresolved"))
    return out.withColumns({f: F.when(F.col("resolution") == "resolved", F.col(f"_late_{f}")).otherwise(F.col(f)) for f in GATEWAY_FIELDS}).drop(
        "_needs", *[f"_late_{f}" for f in GATEWAY_FIELDS])


def reconciliation_report(reconciled: DataFrame, keys: Sequence[str]) -> DataFrame:
    is_ = lambda *names: F.count_if(F.col("resolution").isin(*names))
    return reconciled.groupBy(*keys).agg(
        is_("resolved", "unresolved").alias("required_count"), is_("resolved").alias("resolved_count"), is_("unresolved").alias("unresolved_count"))


def exactly_one(table: DataFrame, lookups: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Value of each lookup with the number of matching rows; the value is null unless exactly one matches."""
    found = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"), F.first(value).alias("_v"))
    out = lookups.join(found, list(keys), "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.withColumn("found", F.when(F.col("matches") == 1, F.col("_v"))).drop("_v")
