"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Targets: the total is shared by weight; a source whose share passes ``most_epochs`` times its own size is clamped there
and the excess goes to the others by weight, until no share passes its clamp. Rows: each is repeated as often as whole
epochs fit; the fractional epoch takes rows in the order of a seeded hash of their key, up to the target, and one more
row of the size that is nearest to what is then missing.

Defined results: null text has size 0; the null source is a source like any other; rows of size 0 are repeated like the
rest of their source up to the cut; an empty table gives an empty one; equal rows get equal copies. Hash and key decide,
so reruns agree. Other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from .common import sized_broadcast, words_of

#: Low bits of the 32-bit draw; the rest number the slices in which a fractional epoch is summed before one is opened.
SLICE_BITS = 20


def source_key(source: Column) -> Column:
    """A non-null key that sorts by code point with null last."""
    return F.when(source.isNull(), "w").otherwise(F.concat(F.lit("v"), source.cast("string")))


def measured(docs: DataFrame, key: str, source: str, text: str, seed: int, keep_rows: bool = False) -> DataFrame:
    """_id, _s, _size in words and _u, a 32-bit draw; with ``keep_rows`` the whole row as _row."""
    cols = [F.col(key).alias("_id"), source_key(F.col(source)).alias("_s"), F.size(words_of(F.col(text))).cast("long").alias("_size"),
            F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 32)).alias("_u")]
    return docs.select(*cols, *([F.struct("*").alias("_row")] if keep_rows else []))


def repeating_weights(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Adds _weight: the given weights in turn, by source. One row per source goes through the ranking."""
    rank = F.row_number().over(Window.orderBy("_s")) - 1
    return sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, share: float = 1.0, most_epochs: float = 3.0) -> DataFrame:
    """Adds _target to a stored table of _s, _source_size, _weight.

    The level only rises and each round clamps at least one more source, so it ends. One aggregate row a round.
    """
    cap, weight = F.col("_source_size") * F.lit(float(most_epochs)), F.col("_weight")
    total = sources.agg(F.sum("_source_size"), F.sum("_weight")).first()
    budget = float(total[0] or 0) * share
    level = budget / total[1] if total[1] else 0.0
    while True:
        clamped = weight * F.lit(level) >= cap
        row = sources.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, weight))).first()
        if not row[1] or (new := (budget - (row[0] or 0.0)) / row[1]) <= level:
            break
        level = new
    return sources.withColumn("_target", F.least(weight * F.lit(level), cap))


def plan(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole epochs, the last (draw, key) of the fractional one, and the row that fills what is missing.

    ``rows`` is a stored table of _id, _s, _size, _u. The order inside a source is needed in one slice of 1/4096 of it
    only: slices are summed by a plain group-by first.
    """
    whole = F.floor(F.coalesce(F.col("_target") / F.nullif(F.col("_source_size"), F.lit(0)), F.lit(0.0)))
    targets = targets.withColumn("_whole", whole).withColumn("_rest", F.col("_target") - F.col("_whole") * F.col("_source_size"))
    sliced = rows.withColumn("_slice", F.shiftright("_u", SLICE_BITS))
    sums = sliced.groupBy("_s", "_slice").agg(F.sum("_size").alias("_sum"))
    w = Window.partitionBy("_s").orderBy("_slice")
    opened = (sums.withColumn("_through", F.sum("_sum").over(w)).join(sized_broadcast(targets), "_s").where("_through > _rest and _rest > 0")
              .groupBy("_s").agg(F.min_by(F.struct("_slice", (F.col("_through") - F.col("_sum")).alias("_before")), "_slice").alias("_open")))
    targets = pin(targets.join(opened, "_s", "left").select("*", F.col("_open._slice").alias("_cut_slice"), F.col("_open._before").alias("_before")).drop("_open"))
    small = sized_broadcast(targets)
    inside = (sliced.join(small.select("_s", "_cut_slice", "_before", "_rest"), "_s").where("_slice = _cut_slice")
              .withColumn("_through", F.col("_before") + F.sum("_size").over(Window.partitionBy("_s").orderBy("_u", "_id")))
              .where("_through <= _rest").groupBy("_s").agg(F.max(F.struct("_u", "_id")).alias("_last")))
    targets = pin(targets.join(inside, "_s", "left"))
    small = sized_broadcast(targets)
    marked = rows.join(small, "_s").withColumn("_in", in_fraction())
    got = marked.groupBy("_s").agg(F.sum(F.when(F.col("_in"), F.col("_size"))).alias("_got"))
    targets = pin(targets.join(got, "_s", "left").withColumn("_missing", F.col("_rest") - F.coalesce("_got", F.lit(0))))
    gap = F.abs(F.col("_size") - F.col("_missing"))
    extra = (rows.join(sized_broadcast(targets), "_s").where(~in_fraction()).where((F.col("_size") > 0) & (gap < F.col("_missing")))
             .groupBy("_s").agg(F.min(F.struct(gap.alias("_gap"), "_u", "_id")).alias("_extra")))
    return pin(targets.join(extra, "_s", "left"))


def in_fraction() -> Column:
    """Whether the row is in the fractional epoch, by its source's cut."""
    slice_ = F.shiftright(F.col("_u"), SLICE_BITS)
    inside = (slice_ == F.col("_cut_slice")) & (F.struct("_u", "_id") <= F.col("_last"))
    return F.coalesce((F.col("_rest") > 0) & ((slice_ < F.col("_cut_slice")) | inside), F.lit(False))


def copies() -> Column:
    """How often a row joined with its source's plan is taken."""
    extra = F.coalesce((F.col("_u") == F.col("_extra._u")) & F.col("_id").eqNullSafe(F.col("_extra._id")), F.lit(False))
    return (F.col("_whole") + (in_fraction() | extra).cast("int")).cast("long")


def mixture(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (1.0, 2.0, 3.0),
            share: float = 1.0, most_epochs: float = 3.0, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): the stored narrow rows and each source's plan. Join on _s and read ``copies()``."""
    rows = pin(measured(docs, key, source, text, seed))
    sources = rows.groupBy("_s").agg(F.sum("_size").alias("_source_size"))
    targets = pin(water_fill(pin(repeating_weights(sources, weights)), share, most_epochs))
    return rows, plan(rows, targets)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17, **options) -> DataFrame:
    """The mixed table: rows of ``docs``, each as many times as the mix takes it."""
    _, per_source = mixture(docs, key, source, text, seed=seed, **options)
    taken = measured(docs, key, source, text, seed, keep_rows=True).join(sized_broadcast(per_source), "_s").withColumn("_n", copies())
    return taken.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")
