"""Column helpers, prefix sums over a sorted table, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin

#: Blank characters between words: ASCII white space only.
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: Column) -> Column:
    """Words between ASCII blanks; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def joined_hashes(left: Column, right: Column, offset: int) -> Column:
    """Hash at i of left[i] and right[i + offset], as far as both exist."""
    n = F.greatest(F.size(right) - offset, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, offset + 1, n), lambda a, b: F.xxhash64(a, b))


def with_window_hashes(df: DataFrame, single: str, width: int, out: str) -> DataFrame:
    """Column ``out``: a hash of each run of ``width`` entries, from the hashes of single entries, by doubling.

    Each step is a projection of its own, so that no array is computed twice.
    """
    df, have, name = df.withColumn(out, F.col(single)), 1, out
    while have < width:
        step = min(have, width - have)
        other = F.col(name) if step == have else F.col(single)
        # a single entry is appended when doubling would overshoot
        df = df.withColumn(out, joined_hashes(F.col(name), other, have))
        have += step if step == have else 1
    return df


def sized_broadcast(small: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """Broadcast a stored table when a count proves it small; otherwise leave the join to adaptive execution."""
    return F.broadcast(small) if small.limit(most_rows + 1).count() <= most_rows else small


def joined_by_share(rows: DataFrame, table: DataFrame, key: str, share: int = 2000) -> DataFrame:
    """Left join on ``key``, unique in ``table`` and never null. A key with over 1/``share`` of the rows is one of fewer than
    ``share``: those are broadcast, the others are shuffled, so no task gets all rows of a common key."""
    sizes = pin(rows.groupBy(key).agg(F.count("*").alias("_size")))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    common = F.broadcast(sizes.where(F.col("_size") * share > total).select(key))
    there = F.broadcast(common.join(table, key, "left"))
    return rows.join(there, key).unionByName(rows.join(common, key, "left_anti").join(table, key, "left"))


def running_offsets(parts: DataFrame, part: str, amount: str, out: str) -> DataFrame:
    """Sum of ``amount`` over all smaller ``part``. One row per partition of a job goes in, however many rows those hold."""
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(part, F.coalesce(F.sum(amount).over(w), F.lit(0)).alias(out))


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components: (id, component) with the smallest id reachable.

    ``nodes`` has id; ``edges`` has a, b. Alternating star contraction: each node hands its larger neighbours, then its
    smaller ones, to the smallest neighbour. A round is two group-bys and joins, linear in the edges whatever the
    degrees; the edge table is written out each round, so a lost executor repeats one round at most. Ends when a round
    changes nothing: then each edge runs from a node to its component.
    """
    ids = nodes.select(F.col("id").cast("long"))
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs, before = pin(pairs), None
    for _ in range(most_rounds):
        pairs = pin(_small_star(_large_star(pairs)))
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return ids.join(pairs.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
