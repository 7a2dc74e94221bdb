"""Comparisons of keyed prediction sets: paired over blocks, and before against after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import summarize_long
from .scoring import set_metrics
from .signflip import signflip_mean


def paired_blocks(first: DataFrame, second: DataFrame, keys: Sequence[str], block: str, metric: str, alpha: float = 0.05, draws: int | None = None) -> DataFrame:
    """Second minus first over the blocks that both have: n, mean, median, t interval, exact sign-flip p, verdict.

    Both frames have keys, block and metric, once each. Two prediction sets may differ in anything: method, training
    protocol, domain; what they differ in is left out of the keys. The interval is the mean itself when all differences
    are equal. Blocks in which either metric is null do not count.
    """
    keys = list(keys)
    side = lambda df, name: df.select(*keys, block, F.col(metric).cast("double").alias(name))
    diffs = side(first, "first").join(side(second, "second"), [*keys, block]).withColumn("value", F.col("second") - F.col("first")).where("value is not null")
    summary = summarize_long(diffs, keys, collapse=True).drop("min", "max")
    tested = signflip_mean(diffs, keys, block, draws=draws).select(*keys, "signflip_p", F.col("method").alias("test"))
    supported = F.coalesce((F.col("mean") > 0) & (F.col("signflip_p") < alpha), F.lit(False))
    return summary.join(tested, keys).withColumn("verdict", F.when(supported, "SUPPORTED").otherwise("NOT_SUPPORTED"))


def metric_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Every metric of two versions of a prediction table: keys, metric, before, after, change. A key of one version only has nulls on the other side."""
    keys = list(keys)

    def long(preds, name):
        return set_metrics(preds, keys).unpivot(keys, list(metrics), "metric", name)

    out = long(before, "before").join(long(after, "after"), [*keys, "metric"], "full")
    return out.withColumn("change", F.col("after") - F.col("before"))
