"""Telemetry cost: paired savings, service guard, quality/cost frontier, decision."""

from __future__ import annotations

import pandas as pd
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import unpivot
from ..session import pin
from .grouped import hot_groups, sized_broadcast
from .runs import summarize_long

FULL = "T0_FULL"
CONFIGS = ["T0_FULL", "T1_NO_HOST", "T2_NO_RUNTIME", "T3_LIGHT"]
COST_COLUMNS = [
    "optional_bytes_per_request", "total_bytes_per_request", "telemetry_rows_per_request", "ttft_p95", "total_latency_p95",
    "successful_requests_per_second",
]


def paired_costs(runs: DataFrame, block: Sequence[str]) -> DataFrame:
    """Every reduced configuration against the full one of its block."""
    base = ["optional_bytes_per_request", "total_latency_p95", "ttft_p95", "successful_requests_per_second"]
    full = runs.where(F.col("telemetry_config") == FULL).select(*block, *[F.col(c).alias(f"_f_{c}") for c in base])
    out = runs.where(F.col("telemetry_config") != FULL).join(full, list(block))
    c, f = F.col, lambda n: F.nullif(F.col(f"_f_{n}"), F.lit(0.0))
    return out.select(
        *block, F.concat(c("telemetry_config"), F.lit(f"_vs_{FULL}")).alias("comparison"),
        (1 - c(base[0]) / f(base[0])).alias("storage_reduction"), (c(f"_f_{base[0]}") - c(base[0])).alias("optional_bytes_saved"),
        (c(base[1]) / f(base[1]) - 1).alias("relative_total_latency_change"), (c(base[2]) / f(base[2]) - 1).alias("relative_ttft_change"),
        (c(base[3]) / f(base[3]) - 1).alias("relative_throughput_change"),
    )


def service_guard(paired: DataFrame, keys: Sequence[str], limit: float = 0.05) -> DataFrame:
    """Interval of the latency change; passes when its upper bound stays within the limit."""
    out = summarize_long(paired, [*keys, "comparison"], "relative_total_latency_change", collapse=True, medians=False)
    return out.withColumn("passes_guard", F.coalesce(F.col("ci_high") <= limit, F.lit(False)).cast("int"))


def cost_table(runs: DataFrame, keys: Sequence[str], columns: Sequence[str] = tuple(COST_COLUMNS)) -> DataFrame:
    return summarize_long(unpivot(runs, [*keys], list(columns), "metric"), [*keys, "metric"], collapse=True, medians=False)


def frontier_rows(names: Sequence[str]):
    """Group function keeping the points no other point beats: one sweep from high quality down, with
    a staircase of the two costs."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect_right

        a_steps: list[float] = []
        b_steps: list[float] = []
        kept = []
        ordered = pdf.sort_values(["q_", "a_", "b_"], ascending=[False, True, True])
        for index, a, b in zip(ordered.index, ordered["a_"], ordered["b_"]):
            at = bisect_right(a_steps, a)
            if at and b_steps[at - 1] <= b:
                continue
            kept.append(index)
            end = at
            while end < len(b_steps) and b_steps[end] >= b:
                end += 1
            a_steps[at:end], b_steps[at:end] = [a], [b]
        return pdf.loc[kept, list(names)]

    return keep


#: Most points of a group that are compared with each other inside one row.
FEW_POINTS = 128


def pareto(points: DataFrame, keys: Sequence[str], quality: str, costs: tuple[str, str], salts: int = 16, few: int = FEW_POINTS) -> DataFrame:
    """Flag points beaten on quality and both costs, one strictly. Equal points do not beat each other; one that lacks a
    value neither beats nor is beaten.

    A group of ``few`` points is one row, whose points are compared there; larger groups are swept.
    """
    keys, points = list(keys), pin(points)
    large, n = hot_groups(points, keys, few)
    if not n:
        return _compared(points, keys, quality, costs)
    large = sized_broadcast(large, n)
    same = [points[k].eqNullSafe(large[k]) for k in keys]
    return _compared(points.join(large, same, "left_anti"), keys, quality, costs).unionByName(_swept(points.join(large, same, "left_semi"), keys, quality, costs, salts))


def _compared(points: DataFrame, keys: list[str], quality: str, costs: tuple[str, str]) -> DataFrame:
    rest = [c for c in points.columns if c not in keys]
    groups = points.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_points"))
    value = lambda p, c: p[c].cast("double")

    def beaten(p):
        def beats(o):
            more, less = value(o, quality), [(value(o, c), value(p, c)) for c in costs]
            strictly = (more > value(p, quality)) | (less[0][0] < less[0][1]) | (less[1][0] < less[1][1])
            return (more >= value(p, quality)) & (less[0][0] <= less[0][1]) & (less[1][0] <= less[1][1]) & strictly

        return F.coalesce(F.exists("_points", beats), F.lit(False)).cast("int")

    judged = F.transform("_points", lambda p: F.struct(*[p[c].alias(c) for c in rest], beaten(p).alias("pareto_dominated")))
    return groups.select(*keys, F.inline(judged))


def _swept(points: DataFrame, keys: list[str], quality: str, costs: tuple[str, str], salts: int) -> DataFrame:
    """Distinct points are thinned to local frontiers level by level, in ``salts`` squared hashed slices, then ``salts``, so
    only frontier points of a group ever meet in one task."""
    dims = {"q_": F.col(quality).cast("double"), "a_": F.col(costs[0]).cast("double"), "b_": F.col(costs[1]).cast("double")}
    distinct = points.select(*keys, *[c.alias(n) for n, c in dims.items()]).dropna(subset=list(dims)).distinct()
    schema = distinct.schema
    local, tasks = distinct, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for slices in (salts * salts, salts):
        # slices are few rows and much work, so their number is not left to the bytes that they have
        dealt = local.withColumn("slice_", F.pmod(F.xxhash64("q_", "a_", "b_"), F.lit(slices))).repartition(tasks, *keys, "slice_")
        local = dealt.groupBy(*keys, "slice_").applyInPandas(frontier_rows(schema.names), schema)
    best = local.groupBy(*keys).applyInPandas(frontier_rows(schema.names), schema).withColumn("_keep", F.lit(1))
    left, right = points.withColumns(dims).alias("p"), best.alias("b")
    tagged = left.join(right, [F.col(f"p.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, *dims]], "left")
    known = F.lit(True)
    for n in dims:
        known = known & F.col(f"p.{n}").isNotNull()
    return tagged.select(*[F.col(f"p.{c}") for c in points.columns], (known & F.col("b._keep").isNull()).cast("int").alias("pareto_dominated"))


def decision(criteria: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All criteria must hold."""
    return criteria.groupBy(*keys).agg(
        F.bool_and(F.col("holds") == 1).alias("_all"), F.count(F.lit(1)).alias("criteria")).select(
        *keys, "criteria", F.when(F.col("_all"), "SUPPORTED").otherwise("NOT_SUPPORTED").alias("decision"))


def integrity_totals(runs: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    valid = F.count_if(F.col("valid") == 1)
    return runs.groupBy(*keys).agg(
        valid.alias("valid_runs"), (F.count(F.lit(1)) - valid).alias("invalid_runs"), F.sum("request_rows").alias("measured_requests"),
        F.sum("successful_requests").alias("successful_measured"), F.sum("admission_failed").alias("admission_failures"),
        ((valid == expected) & (F.count(F.lit(1)) == expected)).cast("int").alias("eligible"))
