"""Degraded telemetry: missing, noisy, lost, delayed or thinned features, and what it costs.

The grid of families, severities and seeds is a column set, so all degraded rows are scored by one
plan against statistics fitted once on clean training rows. Draws come from a portable hash of the
row's own key: the same on every executor, and nested across severities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import portable_normal, portable_uniform, safe_ratio
from .features import NONNEGATIVE_TOKENS, channel_registry
from .runs import summarize_long
from .scoring import by_subset, set_metrics

MISSING_LEVELS = (0.10, 0.25, 0.50)
NOISE_LEVELS = (0.10, 0.25, 0.50)
SAMPLING_LEVELS = (0.75, 0.50, 0.25)
DELAY_LEVELS = (1, 3, 5)


def grid(rows: DataFrame, family: str, levels: Sequence[float], seeds: Sequence[int | None] = (None,)) -> DataFrame:
    """Each row once per severity and seed: a fixed growth factor, no shuffle."""
    points = F.array(*[F.struct(F.lit(float(s)).alias("severity"), F.lit(seed).cast("int").alias("seed")) for s in levels for seed in seeds])
    return rows.withColumn("_g", F.explode(points)).withColumns(
        {"family": F.lit(family), "severity": F.col("_g.severity"), "seed": F.col("_g.seed")}).drop("_g")


def random_missing(rows: DataFrame) -> DataFrame:
    """Null each (run, feature) value with probability ``severity``."""
    u = portable_uniform(F.col("seed"), F.col("run_id"), F.col("feature"))
    return rows.withColumn("value", F.when(u >= F.col("severity"), F.col("value")))


def nonnegative(feature: Column) -> Column:
    return feature.rlike("|".join(NONNEGATIVE_TOKENS))


def gaussian_noise(rows: DataFrame, train_sd: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add normal noise of severity times the training SD; quantities that cannot be negative are clipped."""
    sd = train_sd.select(*keys, "feature", F.col("sd").alias("_sd"))
    drawn = rows.withColumn("_u", portable_normal(F.col("seed"), F.col("run_id"), F.col("feature")))
    return _moved(drawn.join(sd, [*keys, "feature"], "left"))


def noise_grid(rows: DataFrame, train_sd: DataFrame, keys: Sequence[str], levels: Sequence[float], seeds: Column) -> DataFrame:
    """``gaussian_noise`` of each row once a seed of the array ``seeds`` and a level. Rows meet their SD before seeds and
    levels multiply them, and a seed's draw serves all levels."""
    sd = train_sd.select(*keys, "feature", F.col("sd").alias("_sd"))
    seeded = rows.join(sd, [*keys, "feature"], "left").withColumn("seed", F.explode(seeds))
    drawn = seeded.withColumn("_u", portable_normal(F.col("seed"), F.col("run_id"), F.col("feature")))
    return _moved(drawn.withColumn("severity", F.explode(F.array(*[F.lit(float(s)) for s in levels]))))


def _moved(rows: DataFrame) -> DataFrame:
    """Values moved by severity times SD ``_sd`` times draw ``_u``."""
    scale = F.col("_sd") * F.col("severity")
    noisy = F.col("value") + scale * F.col("_u")
    clipped = F.when(nonnegative(F.col("feature")), F.greatest(F.lit(0.0), noisy)).otherwise(noisy)
    # greatest skips nulls, so a missing value must be kept missing explicitly.
    changed = F.when((scale > 0) & F.col("value").isNotNull(), clipped).otherwise(F.col("value"))
    return rows.withColumn("value", changed).drop("_sd", "_u")


def channel_loss(rows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One copy of the rows per lost channel, with that channel's features nulled."""
    reg = channel_registry(rows.sparkSession).withColumn("_hit", F.lit(1))
    grown = rows.withColumn("lost", F.explode(F.array(*[F.lit(c) for c in channels])))
    return grown.join(F.broadcast(reg), ["lost", "feature"], "left").withColumn(
        "value", F.when(F.col("_hit").isNull(), F.col("value"))).drop("_hit")


def point(family: str, x: Column, severity: Column | None = None, seed: Column | None = None, lost: Column | None = None) -> Column:
    held = {"severity": (severity, "double"), "seed": (seed, "int"), "lost": (lost, "string")}
    return F.struct(F.lit(family).alias("family"), *[(F.lit(None) if v is None else v).cast(t).alias(n) for n, (v, t) in held.items()], x.alias("x"))


def _drawn(features: Sequence[str], seeds: Column, draw, levels: Sequence[float], entry) -> Column:
    """Points of every seed and level. A seed's draws, one a feature, are made once and serve all levels."""
    names, steps = F.array(*[F.lit(f) for f in features]), F.array(*[F.lit(float(s)) for s in levels])
    draws = F.transform(seeds, lambda s: F.struct(s.alias("seed"), F.transform(names, lambda f: draw(s, f)).alias("u")))
    return F.flatten(F.transform(draws, lambda e: F.transform(steps, lambda level: entry(e, level))))


def missing_points(features: Sequence[str], seeds: Column) -> Column:
    """``random_missing`` of a run's array ``x`` at every level and seed, as an array of points."""
    draw = lambda s, f: portable_uniform(s, F.col("run_id"), f)
    return _drawn(features, seeds, draw, MISSING_LEVELS, lambda e, level: point(
        "missingness", F.zip_with("x", e["u"], lambda v, u: F.when(u >= level, v)), level, e["seed"]))


def noise_points(features: Sequence[str], seeds: Column) -> Column:
    """``gaussian_noise`` of a run's array ``x`` with the training SDs ``noise_sd``, as an array of points."""
    floored = nonnegative_flags(features)
    draw = lambda s, f: portable_normal(s, F.col("run_id"), f)

    def noisy(e, level):
        def change(v, i):
            scale = F.get("noise_sd", i) * level
            moved = v + scale * F.get(e["u"], i)
            clipped = F.when(F.get(floored, i), F.greatest(F.lit(0.0), moved)).otherwise(moved)
            return F.when((scale > 0) & v.isNotNull(), clipped).otherwise(v)

        return point("noise", F.transform("x", change), level, e["seed"])

    return _drawn(features, seeds, draw, NOISE_LEVELS, noisy)


def nonnegative_flags(features: Sequence[str]) -> Column:
    return F.array(*[F.lit(any(t in f for t in NONNEGATIVE_TOKENS)) for f in features])


def loss_points(features: Sequence[str], channels: dict[str, Sequence[str]]) -> Column:
    """A run's array ``x`` once a lost channel."""
    none = F.lit(None).cast("double")
    each = [F.array(*[none if f in lost else F.get("x", F.lit(i)) for i, f in enumerate(features)]) for lost in channels.values()]
    return F.array(*[point("channel_loss", x, lost=F.lit(c)) for c, x in zip(channels, each, strict=True)])


def reordered_points(features: Sequence[str], replaced: Sequence[str], orders: str, family: str, seeded: bool) -> Column:
    """A run's array ``x`` with the ``replaced`` features taken from each entry of the column ``orders``, null without one."""
    at = {f: i for i, f in enumerate(replaced)}
    return F.transform(F.coalesce(orders, F.array()), lambda o: point(
        family, F.array(*[F.get(o["values"], F.lit(at[f])) if f in at else F.get("x", F.lit(i)) for i, f in enumerate(features)]),
        o["severity"], o["seed"] if seeded else None))


def packed_orders(order: DataFrame, replaced: Sequence[str], stats: Sequence[str], keys: Sequence[str], name: str) -> DataFrame:
    """One row a run with the order features of all its realisations, each an array in the order of ``replaced``."""
    value = lambda f: F.coalesce(*[F.max(F.when(F.concat_ws("_", "metric", F.lit(s)) == f, F.col(s))) for s in stats if f.endswith(s)])
    dealt = order.select("run_id", *keys, "metric", *stats).repartition("run_id")
    each = dealt.groupBy("run_id", *keys).agg(F.array(*[value(f) for f in replaced]).alias("values"))
    return each.groupBy("run_id").agg(F.collect_list(F.struct(*keys, "values")).alias(name))


def score_centroid(test: DataFrame, scale: DataFrame, centre: DataFrame, keys: Sequence[str], point: Sequence[str],
                   features: Sequence[str]) -> DataFrame:
    """Predict degraded test rows with scaling and centroids fitted once on clean training rows."""
    from .diagnose import LABELS, RUN, distance, standardize

    who = [*keys, *[k for k in RUN if k not in keys], *point, "degree", "truth_set", *LABELS]
    entries = [F.max(F.when(F.col("feature") == f, F.col("z"))) for f in features]
    vecs = standardize(test, scale, keys).groupBy(*who).agg(F.array(*entries).alias("x"))
    scored = vecs.join(centre, list(keys)).withColumn("d", distance(F.col("x"), F.col("centre")))
    best = scored.groupBy(*who).agg(F.min(F.struct("d", "cell")).alias("b"))
    return best.select(*who, F.col("b.cell").alias("predicted_set"), (-F.col("b.d")).alias("score"))


def retention(preds: DataFrame, clean: DataFrame, point: Sequence[str], base: Sequence[str], weight: str | None = None) -> DataFrame:
    """Compound accuracy at each grid point against the clean one, and the change in false alarms.

    ``point`` names the grid keys, ``base`` the keys the clean reference shares with them; ``weight`` as in ``set_metrics``.
    """
    names = ["complete_cause_recall", "jaccard", "macro_f1", "over_attribution", "under_attribution"]

    def block(df, keys):
        # Both subsets in one aggregate; a second group-by on the same keys needs no further shuffle,
        # and unlike a join it keeps grid points with null keys.
        parts = set_metrics(by_subset(df).where("subset in ('ALL', 'COMPOUND')"), [*keys, "subset"], weight)
        of = lambda subset, name: F.max(F.when(F.col("subset") == subset, F.col(name)))
        return parts.groupBy(*keys).agg(
            of("COMPOUND", "exact_set_accuracy").alias("compound_exact"), *[of("COMPOUND", n).alias(n) for n in names],
            of("ALL", "control_false_alarm_rate").alias("control_false_alarm_rate"))

    ref = block(clean, base).select(*base, F.col("compound_exact").alias("clean_exact"), F.col("control_false_alarm_rate").alias("clean_alarm"))
    out = block(preds, point).join(ref, list(base))
    return out.withColumns({
        "retention": F.when(F.col("clean_exact") > 0, F.col("compound_exact") / F.col("clean_exact")),
        "absolute_loss": F.col("clean_exact") - F.col("compound_exact"),
        "control_false_alarm_change": F.col("control_false_alarm_rate") - F.col("clean_alarm"),
    })


def over_seeds(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, SD, range and collapsed t interval of the compound accuracy over realisations."""
    out = summarize_long(results, list(keys), "compound_exact", collapse=True, medians=False)
    others = results.groupBy(*keys).agg(
        F.avg("complete_cause_recall").alias("complete_cause_recall"), F.avg("jaccard").alias("jaccard"), F.avg("macro_f1").alias("macro_f1"),
        F.avg("control_false_alarm_rate").alias("control_false_alarm_rate"), F.first("clean_exact").alias("clean_exact"))
    return out.join(others, list(keys)).withColumn("retention", safe_ratio(F.col("mean"), F.col("clean_exact")))


def robustness_auc(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under accuracy against severity from the clean point on, over the severity range.

    ``points`` has one row per (keys, axis, y, clean). A curve has a handful of severities.
    """
    w = Window.partitionBy(*keys).orderBy("axis")
    before_y, before_x = F.coalesce(F.lag("y").over(w), F.col("clean")), F.coalesce(F.lag("axis").over(w), F.lit(0.0))
    area = points.withColumn("_a", (F.col("y") + before_y) / 2 * (F.col("axis") - before_x))
    return area.groupBy(*keys).agg((F.sum("_a") / F.max("axis")).alias("robustness_auc"))


def severity_axis(family: Column, severity: Column) -> Column:
    return (
        F.when(family == "temporal_sampling", 1 - severity).when(family == "delay", severity / max(DELAY_LEVELS)).otherwise(severity)
    )


def domain_difference(auc: DataFrame, keys: Sequence[str]) -> DataFrame:
    side = lambda d: F.max(F.when(F.col("domain") == d, F.col("robustness_auc")))
    return auc.groupBy(*keys).agg(side("source").alias("source_auc"), side("target").alias("target_auc")).withColumn(
        "target_minus_source_auc", F.col("target_auc") - F.col("source_auc"))


def quality_screen(results: DataFrame) -> DataFrame:
    passes = (F.col("retention") >= 0.90) & (F.col("control_false_alarm_change") <= 0.10)
    return results.withColumn("passes_quality_screen", F.coalesce(passes, F.lit(False)).cast("int"))


def best_candidate(screened: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Best candidate per group by retention, then the smaller false-alarm change, then name."""
    order = F.struct(F.coalesce("retention", F.lit(-1.0)), -F.col("control_false_alarm_change"), F.col(name))
    return screened.groupBy(*keys).agg(F.max_by(name, order).alias("best"), F.max("passes_quality_screen").alias("any_pass"))


def recall_loss(cause_table: DataFrame, clean: DataFrame, point: Sequence[str], base: Sequence[str]) -> DataFrame:
    ref = clean.select(*base, "cause", F.col("recall").alias("clean_recall"))
    return cause_table.join(ref, [*base, "cause"]).withColumn("recall_loss", F.col("clean_recall") - F.col("recall"))


def pair_worst_cases(preds: DataFrame, keys: Sequence[str], point: Sequence[str], cases: dict[str, tuple[str, float | None]], weight: str | None = None) -> DataFrame:
    """Exact accuracy of each compound pair in named (family, severity) cases, as columns: the mean over realisations, and
    the worst of all lost channels. ``weight`` as in ``set_metrics``."""
    who, held = [*keys, "condition_id"], F.lit(1) if weight is None else F.col(weight)
    at = preds.where("true_degree = 2").groupBy(*who, *point).agg((F.sum(F.col("correct").cast("double") * held) / F.sum(held)).alias("y"))

    def case(family, severity):
        hit = F.col("family") == family
        return F.avg(F.when(hit if severity is None else hit & (F.col("severity") == severity), F.col("y")))

    return at.groupBy(*keys, F.col("condition_id").alias("compound_pair")).agg(
        *[case(f, s).alias(n) for n, (f, s) in cases.items()], F.min(F.when(F.col("family") == "channel_loss", F.col("y"))).alias("worst_channel"))
