"""Grouped statistics whose exact percentiles survive a hot group.

Counts, sums and moments combine on the map side, so a hot key is no problem for them. An exact
percentile is different: the built-in aggregate holds every distinct value of a group in one
task. Groups above ``HOT_ROWS`` rows therefore take another exact route: an approximate
percentile brackets each wanted rank, one counting pass ranks the bracket, and only the few rows
inside the bracket are ordered.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000
SKETCH_ACCURACY = 50_000
BROADCAST_ROWS = 100_000

_size_memo: dict[tuple, int] = {}


def forget_sizes() -> None:
    _size_memo.clear()


SMALL_SOURCE_ROWS = HOT_ROWS // 16
SMALL_SOURCE_FILES = 64


def _footer_rows(df: DataFrame, files: tuple[str, ...]) -> int:
    memo = (df.sparkSession.sparkContext.applicationId, files)
    if memo not in _size_memo:
        _size_memo[memo] = df.sparkSession.read.parquet(*files).count()
    return _size_memo[memo]


def _small_source(df: DataFrame) -> bool:
    """Whether everything the frame reads is a few small files, by row counts in their footers.

    Operators multiply rows by small design constants only, so nothing derived from such a source
    can hold a hot group.
    """
    files = df.inputFiles()
    if not files or len(files) > SMALL_SOURCE_FILES or not all(f.endswith(".parquet") for f in files):
        return False
    folders = {f.rsplit("/", 1)[0] for f in files}
    rows = 0
    for folder in folders:
        rows += _footer_rows(df, tuple(f for f in files if f.rsplit("/", 1)[0] == folder))
    return rows <= SMALL_SOURCE_ROWS


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int, bound: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Groups with more than ``limit`` rows, and how many there are (one counting job, remembered).

    ``bound`` is a frame that is cheaper to count and whose groups, by those of the keys that it has, are at least as large:
    where it has no hot group, ``df`` is not computed for counting.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    if bound is not None and hot_groups(bound, [k for k in keys if k in bound.columns], limit)[1] == 0:
        return counts.select(*keys), 0
    memo = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(keys), limit)
    if memo not in _size_memo:
        # A caller's own limit (as in tests) is always counted.
        _size_memo[memo] = 0 if limit >= HOT_ROWS and _small_source(df) else counts.count()
    return counts.select(*keys), _size_memo[memo]


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast when the counted size allows it; otherwise leave the join to adaptive execution."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def grouped_stats(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Column] = (),
    quantiles: Mapping[str, Mapping[str, float]] | None = None,
    hot_rows: int | None = None,
    bound: DataFrame | None = None,
) -> DataFrame:
    """``groupBy(keys)`` with ordinary aggregates and exact interpolated percentiles.

    ``quantiles`` maps a value column to ``{output name: p}``. Nulls are ignored; a group with no
    value gives null. ``bound`` as in ``hot_groups``.
    """
    keys = list(keys)
    quantiles = dict(quantiles or {})
    if not quantiles:
        return df.groupBy(*keys).agg(*aggs)
    limit = HOT_ROWS if hot_rows is None else hot_rows
    hot, n_hot = hot_groups(df, keys, limit, bound)
    if n_hot == 0:
        return _direct(df, keys, aggs, quantiles)
    small_hot = sized_broadcast(hot, n_hot)
    # A null key is a group of its own to groupBy, so the split compares null-safely.
    same = [df[k].eqNullSafe(small_hot[k]) for k in keys]
    cold_part = _direct(df.join(small_hot, same, "left_anti"), keys, (), quantiles)
    hot_part = _bracketed(df.join(small_hot, same, "left_semi"), keys, quantiles, n_hot)
    ranks = cold_part.unionByName(hot_part)
    if not aggs:
        return ranks
    plain = df.groupBy(*keys).agg(*aggs)
    names = plain.columns[len(keys):]
    joined = plain.alias("a").join(ranks.alias("q"), [F.col(f"a.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys])
    outs = [o for spec in quantiles.values() for o in spec]
    return joined.select(*[F.col(f"a.{k}") for k in keys], *[F.col(f"q.{o}") for o in outs], *[F.col(f"a.{n}") for n in names])


def _direct(df: DataFrame, keys: list[str], aggs: Sequence[Column], quantiles: Mapping) -> DataFrame:
    pct = [F.percentile(F.col(c).cast("double"), list(spec.values())).alias(f"_q_{c}") for c, spec in quantiles.items()]
    out = df.groupBy(*keys).agg(*pct, *aggs)
    names = out.columns[len(keys) + len(pct):]
    picks = [F.get(f"_q_{c}", F.lit(i)).alias(o) for c, spec in quantiles.items() for i, o in enumerate(spec)]
    return out.select(*keys, *picks, *names)


def _bracketed(df: DataFrame, keys: list[str], quantiles: Mapping, n_hot: int) -> DataFrame:
    outs = [(c, o, p) for c, spec in quantiles.items() for o, p in spec.items()]
    columns = list(quantiles)
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        keys, columns, "_column", "_value"
    ).where(F.col("_value").isNotNull())
    eps = 2.0 / SKETCH_ACCURACY
    probs = sorted({q for *_, p in outs for q in (max(0.0, p - eps), min(1.0, p + eps))})
    sketch = long.groupBy(*keys, "_column").agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_value", probs, SKETCH_ACCURACY).alias("_s"),
    )
    wanted = F.array(*[
        F.struct(
            F.lit(c).alias("c"), F.lit(o).alias("out"), F.lit(p).alias("p"),
            # The ends need no bracket, which also keeps the extreme ranks exact.
            (F.lit(-math.inf) if p - eps <= 0 else F.get("_s", F.lit(probs.index(p - eps)))).alias("low"),
            (F.lit(math.inf) if p + eps >= 1 else F.get("_s", F.lit(probs.index(p + eps)))).alias("high"),
        )
        for c, o, p in outs
    ])
    targets = (
        sketch.select(*keys, "_column", "_n", F.explode(wanted).alias("_w"))
        .where(F.col("_w.c") == F.col("_column"))
        .select(*keys, "_column", "_n", F.col("_w.out").alias("_out"), F.col("_w.low").alias("_low"),
                F.col("_w.high").alias("_high"), ((F.col("_n") - 1) * F.col("_w.p")).alias("_pos"))
    )
    rows = long.alias("l").join(
        sized_broadcast(targets, n_hot * len(outs)).alias("t"),
        [F.col(f"l.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*keys, "_column"]],
    ).select(*[F.col(f"t.{k}").alias(k) for k in keys], "_out", "_pos", "_value",
             (F.col("_value") < F.col("_low")).alias("_under"), (F.col("_value") <= F.col("_high")).alias("_upto"))
    slot = [*keys, "_out"]
    # Rows below the bracket are only counted; rows inside it are reduced to value counts first.
    pieces = rows.where("_under or _upto").groupBy(
        *slot, F.when(~F.col("_under"), F.col("_value")).alias("_v")
    ).agg(F.count(F.lit(1)).alias("_c"), F.first("_pos").alias("_pos"))
    order = Window.partitionBy(*slot).orderBy(F.col("_v").asc_nulls_first())
    ranked = pieces.withColumn("_upper", F.sum("_c").over(order))
    at = lambda pos: F.min(F.when(F.col("_v").isNotNull() & (F.col("_upper") > pos), F.col("_v")))
    picked = ranked.groupBy(*slot).agg(
        F.first("_pos").alias("_pos"), at(F.floor("_pos")).alias("_lo"), at(F.ceil("_pos")).alias("_hi")
    )
    frac = F.col("_pos") - F.floor("_pos")
    value = F.col("_lo") * (1 - frac) + F.col("_hi") * frac
    exact = picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_out") == o, value)).alias(o) for _, o, _ in outs]
    )
    # A hot group whose values are all null has no rank rows, yet keeps its place.
    everyone = df.groupBy(*keys).agg(F.lit(1).alias("_one")).alias("e")
    return everyone.join(exact.alias("x"), [F.col(f"e.{k}").eqNullSafe(F.col(f"x.{k}")) for k in keys], "left").select(
        *[F.col(f"e.{k}") for k in keys], *[F.col(f"x.{o}") for _, o, _ in outs]
    )
