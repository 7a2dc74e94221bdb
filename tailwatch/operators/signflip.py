"""Exact sign-flip tests, past the sizes at which all sign patterns can be listed.

Mean form: meet in the middle. The signed sums of each half of a group's values are listed (2^(n/2) rows a half, equal sums
counted together); a pair of half-sums reaches the observed sum when one is at least a threshold less the other, so the
pairs are counted by one merge of the two lists in order: a running count of the first half's sums, read at the second
half's thresholds. Groups above the skew bound of ``ordered`` are merged over all tasks.

Vector form: the statistic is not a sum, so patterns are walked, 2^(n-1) of them by symmetry. A block holds the table of
all signed sums of ``LOW`` rows and walks the patterns of ``GRAY`` more in Gray-code order, where a step changes one sign of
a running sum; blocks are rows of their own and spread over all tasks.

A group is exact up to ``MOST_MEAN`` (``MOST_VECTOR``) rows. Above that nothing is drawn unless the caller says how many
patterns with ``draws``; ``method`` says for each group which it was, and is 'not computed' with a null p otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import portable_uniform
from ..session import pin
from .ordered import with_rank, with_running_sum

TOLERANCE = 1e-12
MOST_MEAN, MOST_VECTOR = 52, 36
LOW, GRAY = 12, 8


def _method(n: Column, most: int, draws: int | None) -> Column:
    above = F.lit(f"draws={draws}") if draws else F.lit("not computed")
    return F.when(n <= most, F.lit("exact")).otherwise(above)


def _signed_sums(groups: DataFrame, values: str) -> DataFrame:
    """A row for each sign pattern of the array ``values`` (at most 26 long): its signed sum in ``x``."""
    size = F.size(values)
    high = F.explode(F.sequence(F.lit(0), F.expr(f"cast(shiftleft(1, greatest(size({values}) - {LOW}, 0)) as int) - 1")))
    low = F.explode(F.sequence(F.lit(0), F.expr(f"cast(shiftleft(1, least(size({values}), {LOW})) as int) - 1")))
    total = f"aggregate(transform({values}, (v, i) -> if((shiftright(_mask, i) & 1) = 1, v, -v)), 0D, (a, v) -> a + v)"
    spread = groups.where(size > 0).withColumn("_high", high).repartition("_high")
    out = spread.withColumn("_low", low).withColumn("_mask", F.col("_high") * (1 << LOW) + F.col("_low")).drop("_low").withColumn("x", F.expr(total))
    return out.unionByName(groups.where(size == 0).withColumns({"_high": F.lit(0), "_mask": F.lit(0), "x": F.lit(0.0)}))


def signflip_mean(diffs: DataFrame, keys: Sequence[str], order: str, value: str = "value", draws: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Two-sided sign-flip test on the absolute mean of each group: keys, mean, n, signflip_p, method."""
    keys = list(keys)
    rows = diffs.where(F.col(value).isNotNull()).select(*keys, order, F.col(value).cast("double").alias("_v"))
    ranked = with_rank(rows, keys, [order], "_i", "_n", hot_rows=hot_rows)
    observed = rows.groupBy(*keys).agg(F.avg("_v").alias("mean"), F.count("_v").alias("n"))
    # at most MOST_MEAN values a group come together
    small = ranked.where(F.col("_n") <= MOST_MEAN).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_s"))
    small = pin(small.join(observed, keys).withColumns({
        "_sum": F.col("n") * (F.abs("mean") - TOLERANCE), "_values": F.transform("_s", lambda s: s["_v"])}).drop("_s"))
    half = F.floor(F.col("n") / 2).cast("int")
    listed = small.where("_sum > 0")
    one = _signed_sums(listed.withColumn("_half", F.slice("_values", 1, half)), "_half").groupBy(*keys, "x").agg(F.count("*").alias("_a"))
    two = _signed_sums(listed.withColumn("_half", F.slice("_values", half + 1, F.col("n").cast("int"))), "_half")
    two = two.groupBy(*keys, (F.col("_sum") - F.col("x")).alias("x")).agg(F.count("*").alias("_b"))
    # a threshold stands before the sums equal to it
    merged = two.select(*keys, "x", F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_a"), "_b").unionByName(
        one.select(*keys, "x", F.lit(1).alias("_side"), "_a", F.lit(0).cast("long").alias("_b")))
    below = with_running_sum(pin(merged), keys, ["x", "_side"], "_a", "_below", hot_rows=hot_rows)
    pairs = below.groupBy(*keys).agg(F.sum(F.col("_b") * F.col("_below")).alias("_missed"), F.sum("_b").alias("_patterns_b"), F.sum("_a").alias("_patterns_a"))
    # signs mirrored give the mirrored sum: the two tails are equal
    every = F.col("_patterns_a").cast("double") * F.col("_patterns_b")
    tail = pairs.select(*keys, (2 * (every - F.col("_missed")) / every).alias("_p"))
    exact = small.join(tail, keys, "left").select(*keys, F.when(F.col("_sum") > 0, F.col("_p")).otherwise(1.0).alias("signflip_p"))
    if draws:
        large = ranked.where(F.col("_n") > MOST_MEAN)
        stats = drawn_signs(large, draws).groupBy(*keys, "_mask").agg(F.abs(F.avg(F.col("_v") * F.col("_sign"))).alias("_stat")).join(observed, keys)
        exact = exact.unionByName(stats.groupBy(*keys).agg((F.count_if(F.col("_stat") >= F.abs("mean") - TOLERANCE) / draws).alias("signflip_p")))
    return observed.join(exact, keys, "left").withColumn("method", _method(F.col("n"), MOST_MEAN, draws))


def drawn_signs(ranked: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """Each row (position _i) under ``draws`` hashed sign patterns: _mask, _sign."""
    grown = ranked.withColumn("_mask", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return grown.withColumn("_sign", F.when(portable_uniform(seed, F.col("_mask"), F.col("_i")) < 0.5, -1.0).otherwise(1.0))


def _sums(rows: np.ndarray) -> np.ndarray:
    """All signed sums of the rows, one a sign pattern."""
    out = np.zeros((1, rows.shape[1]))
    for r in rows:
        out = np.concatenate((out - r, out + r))
    return out


def block_hits(rows: np.ndarray, block: int, least: float) -> int:
    """Patterns of one block whose statistic reaches ``least``; the first row keeps its sign."""
    free = rows[1:]
    table, walked, fixed = _sums(free[:LOW]), free[LOW:LOW + GRAY], free[LOW + GRAY:]
    signs = (block >> np.arange(len(fixed)) & 1) * 2 - 1
    running = rows[0] + (signs[:, None] * fixed).sum(axis=0) - walked.sum(axis=0)
    hits = 0
    for step in range(1 << len(walked)):
        if step:
            bit = (step & -step).bit_length() - 1
            up = (step ^ step >> 1) >> bit & 1
            running = running + (2 if up else -2) * walked[bit]
        hits += int((np.sqrt(((table + running) ** 2).mean(axis=1)) + TOLERANCE >= least).sum())
    return hits


def signflip_vector(rows: DataFrame, keys: Sequence[str], observed: DataFrame, order: str = "repetition", feature: str = "feature", value: str = "z", draws: int | None = None) -> DataFrame:
    """Sign-flip test of the root mean square of the features' means, one sign a repetition: keys, csd, exact_p, method.

    ``observed`` has keys and csd. Features are a declared list, so a group's matrix is at most ``MOST_VECTOR`` rows of it.
    """
    keys = list(keys)
    reps = pin(with_rank(rows.select(*keys, order).distinct(), keys, [order], "_i", "_n"))
    means = rows.groupBy(*keys, feature).agg(F.count(value).alias("_present"))
    shares = rows.join(means, [*keys, feature]).join(reps, [*keys, order]).select(*keys, feature, "_i", "_n", F.coalesce(F.col(value) / F.col("_present"), F.lit(0.0)).alias("_w"))
    cells = shares.where(F.col("_n") <= MOST_VECTOR).groupBy(*keys).agg(F.max("_n").alias("_n"), F.collect_list(F.struct(F.col(feature).alias("f"), F.col("_i").alias("i"), F.col("_w").alias("w"))).alias("_cells"))
    blocks = F.explode(F.sequence(F.lit(0), F.expr(f"cast(shiftleft(1, greatest(_n - 1 - {LOW + GRAY}, 0)) as int) - 1")))
    spread = cells.join(observed.select(*keys, "csd"), keys).withColumn("_block", blocks).repartition(*keys, "_block")
    out = ", ".join(f"`{k}` {t}" for k, t in spread.select(*keys).dtypes)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hits = []
            for row in frame.itertuples():
                names = sorted({c["f"] for c in row.cells})
                matrix = np.zeros((row.n, len(names)))
                for c in row.cells:
                    matrix[c["i"] - 1, names.index(c["f"])] = c["w"]
                hits.append(block_hits(matrix, row.block, row.csd))
            yield frame[keys].assign(hits=hits)

    named = spread.select(*keys, F.col("_n").alias("n"), F.col("_cells").alias("cells"), F.col("_block").alias("block"), "csd")
    found = named.mapInPandas(count, f"{out}, hits long").groupBy(*keys).agg(F.sum("hits").alias("_hits"))
    sizes = reps.groupBy(*keys).agg(F.max("_n").alias("n"))
    result = observed.select(*keys, "csd").join(sizes, keys).join(found, keys, "left")
    result = result.withColumn("exact_p", F.col("_hits") / F.pow(F.lit(2.0), F.col("n") - 1))
    if draws:
        signs = drawn_signs(reps.where(F.col("_n") > MOST_VECTOR), draws)
        by_feature = rows.join(signs, [*keys, order]).groupBy(*keys, "_mask", feature).agg(F.avg(F.col(value) * F.col("_sign")).alias("_m"))
        stats = by_feature.groupBy(*keys, "_mask").agg(F.sqrt(F.avg(F.pow("_m", 2))).alias("_stat")).join(observed.select(*keys, "csd"), keys)
        large = stats.groupBy(*keys).agg((F.count_if(F.col("_stat") + TOLERANCE >= F.col("csd")) / draws).alias("_drawn"))
        result = result.join(large, keys, "left").withColumn("exact_p", F.coalesce("exact_p", "_drawn"))
    return result.select(*keys, "csd", "exact_p", _method(F.col("n"), MOST_VECTOR, draws).alias("method"))
