"""Ordered operations inside a group: rank, lag, running sum, nearest carried value.

Ordinary groups use a window. When some group exceeds ``HOT_ROWS`` rows the rows are range
partitioned by (group, order), pinned, scanned locally, and the local results are shifted by
per-segment totals. No group then has to fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from .grouped import HOT_ROWS, hot_groups

SEGMENT = "_segment"


def _asc(order: Sequence[str]) -> list[Column]:
    return [F.col(o).asc() for o in order]


def _is_hot(df: DataFrame, keys: Sequence[str], hot_rows: int | None, bound: DataFrame | None = None) -> bool:
    return hot_groups(df, keys, HOT_ROWS if hot_rows is None else hot_rows, bound)[1] > 0


def _segments(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *_asc(order))
    return pin(ranged.withColumn(SEGMENT, F.spark_partition_id()))


def _before(segments: DataFrame, keys: Sequence[str], total: Column, name: str) -> DataFrame:
    """Running total of earlier segments of the same group: one row per (group, segment)."""
    per = segments.groupBy(*keys, SEGMENT).agg(total.alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, SEGMENT, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias(name))


def with_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str = "rn", size: str | None = None,
    hot_rows: int | None = None, bound: DataFrame | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group, and optionally the group size.

    ``order`` must be unique inside a group for the result to be deterministic. ``bound`` as in ``hot_groups``.
    """
    keys = list(keys)
    if not _is_hot(df, keys, hot_rows, bound):
        out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*_asc(order))))
        return out.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*keys))) if size else out
    seg = _segments(df, keys, order)
    offset = _before(seg, keys, F.count(F.lit(1)), "_offset")
    local = seg.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, SEGMENT).orderBy(*_asc(order))))
    out = local.join(offset, [*keys, SEGMENT]).withColumn(rank, (F.col("_local") + F.col("_offset")).cast("int"))
    if size:
        out = out.join(seg.groupBy(*keys).agg(F.count(F.lit(1)).alias(size)), keys)
    return out.drop("_local", "_offset", SEGMENT)


def with_lag(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], shift: int = 1,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add ``{new: source}`` columns holding the value ``shift`` rows earlier; the first rows are null."""
    keys = list(keys)
    if not _is_hot(df, keys, hot_rows):
        w = Window.partitionBy(*keys).orderBy(*_asc(order))
        return df.withColumns({new: F.lag(src, shift).over(w) for new, src in columns.items()})
    ranked = pin(with_rank(df, keys, order, "_rn", hot_rows=hot_rows))
    moved = ranked.select(*keys, (F.col("_rn") + shift).alias("_rn"), *[F.col(s).alias(n) for n, s in columns.items()])
    return ranked.join(moved, [*keys, "_rn"], "left").drop("_rn")


def with_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, hot_rows: int | None = None,
) -> DataFrame:
    keys = list(keys)
    if not _is_hot(df, keys, hot_rows):
        w = Window.partitionBy(*keys).orderBy(*_asc(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(w))
    seg = _segments(df, keys, order)
    offset = _before(seg, keys, F.sum(value), "_offset")
    w = Window.partitionBy(*keys, SEGMENT).orderBy(*_asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = seg.withColumn("_local", F.sum(value).over(w)).join(offset, [*keys, SEGMENT])
    return out.withColumn(name, F.col("_local") + F.col("_offset")).drop("_local", "_offset", SEGMENT)


def with_neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], marker: Column, payload: Sequence[str],
    before: str = "previous", after: str = "following", hot_rows: int | None = None,
) -> DataFrame:
    """Carry the payload of the nearest marked row at or before, and at or after, each row."""
    keys = list(keys)
    tagged = df.withColumn("_mark", F.when(marker, F.struct(*payload)))
    back = lambda *k: Window.partitionBy(*k).orderBy(*_asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    ahead = lambda *k: Window.partitionBy(*k).orderBy(*_asc(order)).rowsBetween(0, Window.unboundedFollowing)
    if not _is_hot(df, keys, hot_rows):
        return tagged.withColumn(before, F.last("_mark", ignorenulls=True).over(back(*keys))).withColumn(
            after, F.first("_mark", ignorenulls=True).over(ahead(*keys))
        ).drop("_mark")
    seg = _segments(tagged, keys, order)
    place = F.struct(*order)
    ends = seg.where("_mark is not null").groupBy(*keys, SEGMENT).agg(
        F.max_by("_mark", place).alias("_last"), F.min_by("_mark", place).alias("_first")
    )
    # Every (group, segment) pair, so that segments without a mark still inherit one.
    ends = seg.groupBy(*keys, SEGMENT).agg(F.count(F.lit(1)).alias("_n")).join(ends, [*keys, SEGMENT], "left")
    w = Window.partitionBy(*keys).orderBy(SEGMENT)
    carried = ends.select(
        *keys, SEGMENT,
        F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_in_before"),
        F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_in_after"),
    )
    out = seg.withColumn("_b", F.last("_mark", ignorenulls=True).over(back(*keys, SEGMENT))).withColumn(
        "_a", F.first("_mark", ignorenulls=True).over(ahead(*keys, SEGMENT))
    ).join(carried, [*keys, SEGMENT])
    return out.withColumn(before, F.coalesce("_b", "_in_before")).withColumn(after, F.coalesce("_a", "_in_after")).drop(
        "_mark", "_b", "_a", "_in_before", "_in_after", SEGMENT
    )
