"""Shards of near equal bytes by a k-d tree over metadata.

The table is split again and again at a weighted quantile of the dimension in which a part spreads widest, until each leaf
holds the target bytes. Spread is the root mean square distance of two bytes drawn from the part: for numbers as a share
of the whole table's range, for categories with distance 1 between any two, so that both are on one scale. A quantile is found in a few counting passes over 12 bits of the key at a time: each pass sums
bytes per part and digit, opens the one digit that the cut falls into, and reads on in that digit alone. So a pass
shuffles at most 4096 sums a part and task, however the keys are distributed, and no part is ever sorted.

Equal texts take the metadata of their smallest key and share the low bits of every dimension's key, so a cut falls
between them only where their group outweighs the tolerance. Rows of one key value are then told apart by a hash of
their own key, and rows of one key by the place they are stored at: a group of copies of any size is split evenly.

Slots in a leaf follow from one range partitioning by leaf and key: places within a task, and a running count over the
tasks of a leaf (one row for each task and leaf that it holds).

Defined results: null text has no bytes; null categories are a category, null numbers are the smallest number; equal
rows, those of null keys too, are placed one by one; an empty table gives an empty one. Extra columns are not read. Dimension keys hold the value
in 24 bits (categories by hash) and the text's hash in 36.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin

DIGIT, DIGITS, VALUE_BITS = 12, 5, 24
#: Bits of the tie key that tell rows of one key apart.
PLACE_BITS = 16
#: Tolerated error of a cut, as a share of a leaf's bytes.
TOLERANCE = 0.005
ROW_BYTES = 16


def _category(c: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(c.cast("string"), F.lit("\u0000"))), 64 - VALUE_BITS)


def _number(c: Column) -> Column:
    """A non-negative number on a log scale up to 2**40; null and negative ones below."""
    scaled = F.log2(F.greatest(c.cast("double"), F.lit(0.0)) + 2) / 41 * (1 << VALUE_BITS)
    return F.coalesce(F.least(scaled.cast("long"), F.lit((1 << VALUE_BITS) - 1)), F.lit(0).cast("long"))


def measured(docs: DataFrame, key: str, text: str, categories: list[str], numbers: list[str]) -> DataFrame:
    """_id, _size, _crc, the dimension keys _k (60 bits each) and the tie key _tie."""
    whole = F.coalesce(F.col(text), F.lit(""))
    values = F.array(*[_category(F.col(c)) for c in categories], *[_number(F.col(c)) for c in numbers])
    rows = pin(docs.select(F.col(key).alias("_id"), (F.octet_length(whole) + ROW_BYTES).cast("long").alias("_size"),
                           F.crc32(whole.cast("binary")).alias("_crc"), F.xxhash64(whole).alias("_group"), values.alias("_v"))
               .withColumn("_place", F.monotonically_increasing_id()))
    first = rows.groupBy("_group").agg(F.count("*").alias("_n"), F.min(F.struct("_id", "_v")).alias("_first")).where("_n > 1")
    rows = rows.join(first, "_group", "left").withColumn("_v", F.coalesce("_first._v", "_v"))
    low = F.shiftrightunsigned("_group", 64 - (DIGIT * DIGITS - VALUE_BITS))
    keys = F.transform("_v", lambda v: v * (1 << (DIGIT * DIGITS - VALUE_BITS)) + low)
    own = F.shiftrightunsigned(F.xxhash64(F.col("_id"), F.lit("tie")), 64 - DIGIT * DIGITS + PLACE_BITS)
    tie = F.shiftleft(own, PLACE_BITS) + F.shiftrightunsigned(F.xxhash64("_place"), 64 - PLACE_BITS)
    return rows.select("_id", "_size", "_crc", keys.alias("_k"), tie.alias("_tie"))


def _value(d: int) -> Column:
    return F.shiftright(F.get("_k", F.lit(d)), DIGIT * DIGITS - VALUE_BITS)


def _ranges(rows: DataFrame, categories: int, dims: int) -> list[float]:
    """Range of each numeric dimension over the whole table, at least one step."""
    if dims == categories:
        return []
    found = rows.agg(*[(F.max(_value(d)) - F.min(_value(d))).alias(f"_r{d}") for d in range(categories, dims)]).first()
    return [float(max(r or 0, 1)) for r in found]


def _widest(rows: DataFrame, categories: int, dims: int, ranges: list[float]) -> DataFrame:
    """Per part: bytes, and the dimension of the largest spread; ties go to the first."""
    size = F.col("_size").cast("double")
    sums = [F.sum("_size").alias("_bytes")]
    for d in range(categories, dims):
        x = _value(d) / F.lit(ranges[d - categories])
        sums += [F.sum(size * x).alias(f"_x{d}"), F.sum(size * x * x).alias(f"_y{d}")]
    parts = rows.groupBy("_part", "_leaves").agg(*sums)
    spreads = [F.struct(F.sqrt(F.greatest(F.lit(0.0), 2 * (F.col(f"_y{d}") / F.col("_bytes") - F.pow(F.col(f"_x{d}") / F.col("_bytes"), 2)))).alias("s"), F.lit(-d).alias("d"))
               for d in range(categories, dims)]
    if categories:
        values = F.posexplode(F.array(*[_value(d) for d in range(categories)])).alias("_d", "_value")
        shares = rows.select("_part", "_size", values).groupBy("_part", "_d", "_value").agg(F.sum("_size").cast("double").alias("_b"))
        apart = F.sqrt(F.greatest(F.lit(0.0), 1 - F.sum(F.col("_b") * F.col("_b")) / F.pow(F.sum("_b"), 2)))
        mixed = shares.groupBy("_part", "_d").agg(apart.alias("_s"))
        parts = parts.join(mixed.groupBy("_part").agg(F.max(F.struct(F.col("_s").alias("s"), (-F.col("_d")).alias("d"))).alias("_mixed")), "_part")
        spreads.append(F.col("_mixed"))
    best = F.greatest(*spreads) if len(spreads) > 1 else spreads[0]
    return parts.select("_part", "_leaves", "_bytes", (-best["d"]).alias("_dim"))


def _cuts(rows: DataFrame, parts: DataFrame, leaf_bytes: float) -> DataFrame:
    """Per part: _cut and _cut_tie; rows up to (_cut, _cut_tie) go left, with bytes as near as can be to the left leaves' share."""
    full = (1 << (DIGIT * DIGITS)) - 1
    wanted = F.col("_bytes") * F.floor(F.col("_leaves") / 2) / F.col("_leaves")
    open_ = pin(parts.select("_part", "_dim", wanted.alias("_want"), F.lit(0.0).alias("_before"), F.lit(0).cast("long").alias("_pk"), F.lit(0).cast("long").alias("_pt")))
    done = []
    for step in range(2 * DIGITS):
        on_tie, shift = step >= DIGITS, DIGIT * (DIGITS - 1 - step % DIGITS)
        key = F.get("_k", F.col("_dim"))
        digits = F.col("_tie") if on_tie else key
        prefix = F.col("_pt") if on_tie else F.col("_pk")
        inside = F.shiftright(digits, shift + DIGIT) == prefix
        if on_tie:
            inside = inside & (key == F.col("_pk"))
        sums = (rows.join(open_, "_part").where(inside).groupBy("_part", F.shiftright(digits, shift).alias("_cell"))
                .agg(F.sum("_size").alias("_sum"), F.count("*").alias("_rows")))
        w = Window.partitionBy("_part").orderBy("_cell")
        crossed = (sums.withColumn("_through", F.sum("_sum").over(w)).join(open_, "_part")
                   .withColumns({"_hi": F.col("_before") + F.col("_through"), "_lo": F.col("_before") + F.col("_through") - F.col("_sum")})
                   .where("_hi >= _want")
                   .groupBy("_part").agg(F.min_by(F.struct("_cell", "_lo", "_hi", "_rows"), "_cell").alias("_c")))
        state = pin(open_.join(crossed, "_part").select("_part", "_dim", "_want", "_pk", "_pt", "_c.*")
                    .withColumn("_below", (F.col("_want") - F.col("_lo")) < (F.col("_hi") - F.col("_want")))
                    .withColumn("_done", (F.least(F.col("_want") - F.col("_lo"), F.col("_hi") - F.col("_want")) <= leaf_bytes * TOLERANCE)
                                | (F.col("_rows") == 1) | F.lit(step == 2 * DIGITS - 1)))
        edge = F.shiftleft(F.col("_cell") + F.when(F.col("_below"), 0).otherwise(1), shift) - 1
        if on_tie:
            bound = [F.col("_pk").alias("_cut"), edge.alias("_cut_tie")]
        else:
            bound = [edge.alias("_cut"), F.lit(full).alias("_cut_tie")]
        done.append(state.where("_done").select("_part", "_dim", *bound))
        state = state.where("not _done")
        if not state.limit(1).count():
            break
        nxt = ["_pk", F.col("_cell").alias("_pt")] if on_tie else [F.col("_cell").alias("_pk"), F.lit(0).cast("long").alias("_pt")]
        open_ = state.select("_part", "_dim", "_want", F.col("_lo").alias("_before"), *nxt)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return pin(out)


def kd_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", categories: list[str] | None = None, numbers: list[str] | None = None,
              shards: int | None = None, target_bytes: int = 256 << 20) -> DataFrame:
    """One row per document: _id, _size, _crc, _part, the leaf from 0 on, and _tie, which tells equal rows apart. Leaves number ``shards``, or as many as make
    them ``target_bytes``."""
    categories = ["source", "lang"] if categories is None else categories
    numbers = ["n_chars"] if numbers is None else numbers
    rows = pin(measured(docs, key, text, categories, numbers))
    total = rows.agg(F.sum("_size")).first()[0] or 0
    leaves = shards or max(1, math.ceil(total / target_bytes))
    ranges = _ranges(rows, len(categories), len(categories) + len(numbers))
    rows = rows.withColumns({"_part": F.lit(0), "_leaves": F.lit(leaves)})
    for _ in range(math.ceil(math.log2(leaves)) if total and leaves > 1 else 0):
        # a part is named after its first leaf, so that halves need no table of names
        parts = pin(_widest(rows.where("_leaves > 1"), len(categories), len(categories) + len(numbers), ranges))
        cuts = _cuts(rows, parts, total / leaves)
        key_ = F.get("_k", F.col("_dim"))
        left = (key_ < F.col("_cut")) | ((key_ == F.col("_cut")) & (F.col("_tie") <= F.col("_cut_tie")))
        half = F.floor(F.col("_leaves") / 2).cast("int")
        split = rows.join(cuts, "_part", "left").withColumn("_left", left)
        rows = pin(split.select(
            "_id", "_size", "_crc", "_k", "_tie",
            F.when(F.col("_left") | F.col("_left").isNull(), F.col("_part")).otherwise(F.col("_part") + half).alias("_part"),
            F.when(F.col("_left").isNull(), F.col("_leaves")).when(F.col("_left"), half).otherwise(F.col("_leaves") - half).alias("_leaves")))
    return rows.select("_id", "_size", "_crc", "_part", "_tie")


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds _slot, gapless in each leaf by key."""
    order = ["_part", "_id", "_tie"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    # the identifier counts the rows of a sorted partition in its low 33 bits
    ranged = pin(ranged.withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    pieces = ranged.groupBy("_part", "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a task holds a run of leaves, so pieces are at most as many as tasks and leaves together
    pieces = pieces.select("_part", "_task", (before - F.col("_first")).alias("_shift"))
    return ranged.join(F.broadcast(pieces), ["_part", "_task"]).withColumn("_slot", F.col("_at") + F.col("_shift")).drop("_task", "_at", "_shift", "_tie")
