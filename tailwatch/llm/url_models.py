"""URL filter: rules for hosts and paths, and character language models for the addresses that no rule decides.

Rules say allow or block for a host, its subdomains and a path prefix; the longest that fits decides. Addresses that rules
decide also teach two variable-order Markov models of characters, one of accepted and one of rejected addresses. The
chance of a character after up to ``ORDER`` characters is smoothed from the shortest context to the longest: at each
length the counts of the context are mixed with the shorter context's chance, which weighs as much as the context has
different successors; contexts seen fewer than ``LEAST`` times in a model are left to the shorter one. An address's score
is the mean over its characters, end mark included, of log(accepted chance) - log(rejected chance). The threshold is the
score that best parts a fifth of the decided addresses (by hash), which teach nothing; scores below it are blocked.

Everything is counted over all rows by grouping, so the models grow with the input. A gram's log ratio is worked out once
for each distinct gram of the addresses, as an integer of millionths, so that sums do not depend on their order. Joins on
grams are parted: a gram with over 1/``SHARE`` of all rows is one of fewer than ``SHARE`` and is broadcast, the others are
shuffled, so that no task gets the grams that all addresses share. Only the scores' histogram, at most 40,001 rows,
reaches the driver.

Defined results: a null address and one without ``://`` have an empty host and path and no rule; null and empty addresses
score by the end mark alone; without accepted or without rejected addresses to learn from all scores are 0 and all
verdicts allow; without a fifth to calibrate with, of both kinds, the threshold is 0; letters A-Z are lowered before
counting; equal addresses get equal answers, rows that repeat a key stay rows of their own; an empty table gives an empty
one. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import joined_by_share

ORDER, LEAST = 5, 2
#: Chance of a character that nothing was seen of.
FLOOR = 1.0 / 1024
SHARE = 2000
#: Steps of a score for the calibration, and the score in such steps beyond which all count as one.
STEPS, MOST_STEPS = 1000, 20_000
_START, _END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule, host, path, verdict.
RULES = [("net/", "net", "/", "block"), ("example.net/en/", "example.net", "/en/", "allow"), ("example.com/de/", "example.com", "/de/", "block"), ("org/fr/", "org", "/fr/", "allow")]


def lowered(text: Column) -> Column:
    """A-Z to a-z, other letters as they are."""
    return F.translate(text, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def deciding_rule(host: Column, path: Column, rules: list[tuple[str, str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. The list is part of the expression: keep it to some hundred rules."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    longest = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    return reduce(lambda rest, r: F.when(fits(r[1], r[2]), F.struct(F.lit(r[0]).alias("rule"), F.lit(r[3]).alias("verdict"))).otherwise(rest),
                  reversed(longest), F.lit(None).cast("struct<rule:string,verdict:string>"))


def grams(df: DataFrame, url: str, order: int = ORDER) -> DataFrame:
    """Adds gram, a row a character: it and the ``order`` characters before it."""
    marked = F.concat(F.lit(_START * order), lowered(F.coalesce(url, F.lit(""))), F.lit(_END))
    at = F.explode(F.sequence(F.lit(1), F.length("_marked") - order))
    return df.withColumn("_marked", marked).withColumn("_at", at).withColumn("gram", F.substring("_marked", F.col("_at"), order + 1)).drop("_marked", "_at")


def statistics(taught: DataFrame, url: str, accepted: str, order: int = ORDER) -> DataFrame:
    """For each string of up to ``order`` + 1 characters: how often each model saw it (a, r), how often a character followed it (ca, cr), and how many different ones (ta, tr)."""
    full = grams(taught, url, order).groupBy("gram").agg(F.sum(F.col(accepted).cast("long")).alias("a"), F.sum((~F.col(accepted)).cast("long")).alias("r"))
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda n: F.substring("gram", -n, n)))
    seen = pin(full.withColumn("s", ends).groupBy("s").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    followed = seen.withColumn("s", F.expr("substring(s, 1, length(s) - 1)")).groupBy("s").agg(
        F.sum("a").alias("ca"), F.sum("r").alias("cr"), F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum((F.col("r") > 0).cast("long")).alias("tr"))
    both = seen.join(followed, "s", "full")
    return both.select("s", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("a", "r", "ca", "cr", "ta", "tr")])


def log_ratios(wanted: DataFrame, stats: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, ratio: millionths of the log ratio of the two models' chances, for each gram in ``wanted``."""
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(part).alias("part"), s.alias("s")) for k in range(order + 1)
                     for part, s in (("gram", F.expr(f"right(gram, {k + 1})")), ("context", F.expr(f"left(right(gram, {k + 1}), {k})")))])
    parts = wanted.select("gram", F.explode(keys).alias("_p")).select("gram", "_p.k", "_p.part", "_p.s")
    found = joined_by_share(parts, stats, "s", SHARE)
    pick = lambda k, part, c: F.coalesce(F.max(F.when((F.col("k") == k) & (F.col("part") == part), F.col(c))), F.lit(0)).cast("double")
    per = found.groupBy("gram").agg(*[pick(k, part, c).alias(f"{c}{k}") for k in range(order + 1) for part, cs in (("gram", ("a", "r")), ("context", ("ca", "cr", "ta", "tr"))) for c in cs])

    for model in ("a", "r"):
        per = per.withColumn(f"p{model}", F.lit(FLOOR))
        for k in range(order + 1):
            n, c, t, p = F.col(f"{model}{k}"), F.col(f"c{model}{k}"), F.col(f"t{model}{k}"), F.col(f"p{model}")
            # a projection of its own each time, so that no chance is written out twice
            per = per.withColumn(f"p{model}", F.when(c >= LEAST, (n + t * p) / (c + t)).otherwise(p))
    return per.select("gram", F.round((F.ln("pa") - F.ln("pr")) * 1_000_000).cast("long").alias("ratio"))


def scores(rows: DataFrame, url: str, stats: DataFrame, order: int = ORDER) -> DataFrame:
    """Adds score in steps of 1/``STEPS``, from the mean log ratio of the characters. ``rows`` needs a column _row that tells rows apart."""
    at = grams(rows.select("_row", F.col(url).alias("_url")), "_url", order).select("_row", "gram")
    ratios = pin(log_ratios(at.groupBy("gram").agg(F.lit(1).alias("_one")).select("gram"), stats, order))
    sums = joined_by_share(at, ratios, "gram", SHARE).groupBy("_row").agg(F.sum("ratio").alias("_sum"), F.count("*").alias("_n"))
    step = F.round(F.col("_sum") / F.col("_n") * F.lit(STEPS / 1_000_000)).cast("long")
    return rows.join(sums, "_row").withColumn("steps", F.greatest(F.lit(-MOST_STEPS), F.least(F.lit(MOST_STEPS), step))).drop("_sum", "_n")


def best_threshold(counts: list[tuple[int, int, int]]) -> int:
    """The score from which on addresses are accepted, of (score, accepted, rejected): best mean of both kinds' shares told rightly, then nearest to 0."""
    kept = sorted(counts)
    accepted, rejected = sum(c[1] for c in kept), sum(c[2] for c in kept)
    if not accepted or not rejected:
        return 0
    steps = np.array([c[0] for c in kept])
    below_a = np.concatenate(([0], np.cumsum([c[1] for c in kept])))
    below_r = np.concatenate(([0], np.cumsum([c[2] for c in kept])))
    right = rejected * (accepted - below_a) + accepted * below_r  # whole numbers, so that ties are ties
    best = np.flatnonzero(right == right.max())
    low, high = np.concatenate(([-MOST_STEPS], steps + 1))[best], np.concatenate((steps, [MOST_STEPS + 1]))[best]
    near = np.clip(0, low, high)  # any threshold after the scores below it and up to the next one parts alike
    return int(min(near.tolist(), key=lambda t: (abs(t), t)))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """key, host, path, rule, verdict, score (mean log ratio) of every row."""
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")).withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    rows = rows.withColumn("_by", deciding_rule(F.col("host"), F.col("path"), rules)).withColumn("_row", F.monotonically_increasing_id())
    rows = pin(rows.select("_row", "_key", "_url", "host", "path", "_by.rule", F.col("_by.verdict").alias("_ruled")))
    ruled = rows.where("_ruled is not null").withColumn("_accepted", F.col("_ruled") == "allow")
    aside = F.crc32(F.col("_url").cast("binary")) % 5 == 0
    taught = ruled.where(~aside)
    stats = pin(statistics(taught, "_url", "_accepted", order))
    known = {r["_accepted"] for r in taught.select("_accepted").distinct().collect()} == {True, False}
    scored = pin(scores(rows, "_url", stats, order))
    counts = scored.where(F.col("_ruled").isNotNull() & aside).groupBy("steps").agg(
        F.sum((F.col("_ruled") == "allow").cast("long")).alias("a"), F.sum((F.col("_ruled") == "block").cast("long")).alias("r")).collect()
    least = best_threshold([tuple(c) for c in counts])
    by_model = F.when((F.col("steps") < least) & F.lit(known), "block").otherwise("allow")
    score = F.when(F.lit(known), F.col("steps") / STEPS).otherwise(F.lit(0.0))
    return scored.select(F.col("_key").alias(key), "host", "path", "rule", F.coalesce("_ruled", by_model).alias("verdict"), score.alias("score"), (F.lit(least) / STEPS).alias("threshold"))
