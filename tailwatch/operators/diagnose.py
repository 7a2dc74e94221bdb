"""Naming the set of active causes of a run: folds, scaling, neighbours, centroids, evidence.

Runs come long: ``(campaign_id, condition_id, repetition, run_id, degree, label_*, feature, value)``.
Training statistics are grouped aggregates over a fold column, so all folds train in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions.core import NUMERICAL_FLOOR, clip, mean_of_present
from .design import CAUSES, CAUSE_SETS, conditions
from .derive import cause_labels, label_indicators, set_key
from ..session import pin
from .features import evidence_registry, evidence_rows, plain_group_rows
from .grouped import grouped_stats

LABELS = [f"label_{c}" for c in CAUSES]
RUN = ["campaign_id", "condition_id", "repetition", "run_id"]


def _with_run(keys) -> list[str]:
    """Group keys and run keys without repeats."""
    return [*keys, *[k for k in RUN if k not in keys]]


Z_LIMIT = 5.0
SEPARATION = 0.05
VARIANCE_FLOOR = 0.10
VARIANTS = [("D4-S", 0), ("D4-SM", 0), ("D4-SMT", 0), ("D4-FULL", 0), ("D4-FULL-F3", 1)]


def labels(spark: SparkSession) -> DataFrame:
    """Condition table with causes: degree, indicators and display key."""
    causes = cause_labels(F.col("active_mechanisms"))
    return conditions(spark).select(
        "condition_id", F.col("compound_degree").alias("degree"), set_key(causes).alias("truth_set"),
        *[c.alias(n) for n, c in label_indicators(causes).items()],
    )


def labelled(long: DataFrame) -> DataFrame:
    return long.join(F.broadcast(labels(long.sparkSession)), "condition_id")


def with_folds(rows: DataFrame, campaign: str = "campaign_id") -> DataFrame:
    """Each row once for every repetition that occurs in its campaign; a campaign's list is one short row."""
    folds = rows.groupBy(campaign).agg(F.collect_set("repetition").alias("_folds"))
    return rows.join(F.broadcast(folds), campaign).withColumn("fold", F.explode("_folds")).drop("_folds")


def split_folds(rows: DataFrame, protocol: str = "P1", campaign: str = "campaign_id") -> DataFrame:
    """Leave-one-repetition-out roles. P1 trains on at most one cause; P2 trains on everything.

    A row appears once per fold it takes part in: as test of its own repetition, as training of the
    others. The folds of a campaign are the repetitions that occur in it.
    """
    grown = with_folds(rows, campaign)
    test = F.col("fold") == F.col("repetition")
    train = ~test & (F.col("degree") <= 1) if protocol == "P1" else ~test
    return grown.withColumn("role", F.when(test, "test").when(train, "train")).where("role is not null")


def scaling(train: DataFrame, keys: Sequence[str], sample: bool = False, hot_rows: int | None = None) -> DataFrame:
    """Training median, and mean and SD after median imputation. A zero SD becomes one.

    The moments of the present values and the number of missing ones give those after imputation, so one aggregate is enough.
    """
    keys, v = [*keys, "feature"], F.col("value")
    aggs = [F.count(v).alias("_n"), F.count_if(v.isNull()).alias("_k"), F.avg(v).alias("_m"), F.var_pop(v).alias("_v")]
    out = grouped_stats(train, keys, aggs, {"value": {"fill": 0.5}}, hot_rows)
    n, k, m, fill = F.col("_n"), F.col("_k"), F.col("_m"), F.col("fill")
    rows = n + k
    squares = n * F.col("_v") + n * k / rows * (m - fill) * (m - fill)
    sd = F.sqrt(squares / (F.nullif(rows - 1, F.lit(0)) if sample else rows))
    mu = F.when(k == 0, m).otherwise((n * m + k * fill) / rows)
    return out.select(*keys, "fill", mu.alias("mu"), F.when(F.coalesce(sd, F.lit(0.0)) > NUMERICAL_FLOOR, sd).otherwise(1.0).alias("sd"))


def fold_scaling(long: DataFrame, protocol: str = "P1", sample: bool = False) -> DataFrame:
    """``scaling`` of every leave-one-repetition-out fold. Rows are dealt by campaign and feature before folds multiply them."""
    rows = long.select("campaign_id", "repetition", "degree", "feature", "value")
    folds = rows.groupBy("campaign_id").agg(F.collect_set("repetition").alias("_folds"))
    dealt = (rows.where("degree <= 1") if protocol == "P1" else rows).repartition("campaign_id", "feature").join(F.broadcast(folds), "campaign_id")
    grown = dealt.withColumn("fold", F.explode("_folds")).drop("_folds").where("fold <> repetition")
    return scaling(grown, ["campaign_id", "fold"], sample)


def _in_folds(rows: DataFrame, protocol: str) -> DataFrame:
    """Roles of rows that stand beside a fold."""
    test, learns = F.col("fold") == F.col("repetition"), F.col("degree") <= 1 if protocol == "P1" else F.lit(True)
    return rows.withColumn("role", F.when(test, "test").when(learns, "train")).where("role is not null")


def standard_folds(long: DataFrame, scale: DataFrame, protocol: str = "P1") -> DataFrame:
    """``standardize`` in every fold: joined a row a (run, feature), multiplied by folds after."""
    held = ["fold", "fill", "mu", "sd"]
    packed = scale.groupBy("campaign_id", "feature").agg(F.collect_list(F.struct(*held)).alias("_f"))
    each = long.join(packed, ["campaign_id", "feature"]).withColumn("_f", F.explode("_f"))
    rows = _in_folds(each.select(*long.columns, *[f"_f.{c}" for c in held]), protocol)
    return rows.withColumn("z", (F.coalesce("value", "fill") - F.col("mu")) / F.col("sd"))


def standard_vectors(long: DataFrame, scale: DataFrame, features: Sequence[str], protocol: str = "P1") -> DataFrame:
    """``vectors`` of ``standard_folds`` without a row a (run, fold, feature)."""
    held = ["fill", "mu", "sd"]
    at = lambda c: F.array(*[F.max(F.when(F.col("feature") == f, F.col(c))) for f in features]).alias(c)
    wide = scale.groupBy("campaign_id", "fold").agg(*[at(c) for c in held])
    runs = feature_vectors(long, ["campaign_id"], features).join(wide, "campaign_id")
    z = F.expr("transform(x, (v, i) -> (coalesce(v, fill[i]) - mu[i]) / sd[i])")
    return _in_folds(runs, protocol).withColumn("x", z).select("fold", *RUN, "role", "degree", "truth_set", *LABELS, "x")


def standardize(rows: DataFrame, scale: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Impute and scale with training statistics only."""
    return rows.join(scale, [*keys, "feature"]).withColumn("z", (F.coalesce("value", "fill") - F.col("mu")) / F.col("sd"))


def vectors(standard: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per run with its features as an array, in registry order."""
    entries = [F.max(F.when(F.col("feature") == f, F.col("z"))) for f in features]
    return standard.groupBy(*_with_run(keys), "role", "degree", "truth_set", *LABELS).agg(F.array(*entries).alias("x"))


def distance(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda u, v: F.coalesce((u - v) * (u - v), F.lit(0.0)))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda acc, v: acc + v))


def centroids(train: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Mean vector of each label set; at most one per declared set."""
    return train.groupBy(*keys, F.col("truth_set").alias("cell")).agg(
        F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(width)]).alias("centre"))


def nearest_centroid(vecs: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Closest centroid, ties to the smaller key. Each test run meets at most eleven centroids."""
    centre = centroids(vecs.where("role = 'train'"), keys, width)
    scored = vecs.where("role = 'test'").join(centre, list(keys)).withColumn("d", distance(F.col("x"), F.col("centre")))
    best = scored.groupBy(*_with_run(keys), "degree", "truth_set", *LABELS).agg(F.min(F.struct("d", "cell")).alias("b"))
    return best.select(*_with_run(keys), "degree", "truth_set", *LABELS, F.col("b.cell").alias("predicted_set"), (-F.col("b.d")).alias("score"))


#: Least number of rings of a cell, and training runs a ring should hold: rings grow with their cell.
RINGS, RING_ROWS = 64, 256


def nearest_neighbour(vecs: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Exact nearest training run, ties to the smaller run id, without forming all pairs.

    Training runs sit in rings around the centroid of their label set. The triangle inequality gives
    each test run an upper bound on its nearest distance, and with it the few rings that can hold
    the answer; only those rings are joined.
    """
    keys = list(keys)
    train, test = vecs.where("role = 'train'"), vecs.where("role = 'test'")
    centre = centroids(train, keys, width)
    inside = train.withColumn("cell", F.col("truth_set")).join(centre, [*keys, "cell"]).withColumn("r", distance(F.col("x"), F.col("centre")))
    cells = inside.groupBy(*keys, "cell").agg(F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.first("centre").alias("centre"), F.count(F.lit(1)).alias("members"))
    step = F.greatest(F.col("r_max") / F.greatest(F.lit(RINGS), F.col("members") / RING_ROWS), F.lit(NUMERICAL_FLOOR))
    ring = lambda r: F.floor(r / F.col("step")).cast("int")
    placed = inside.join(cells.select(*keys, "cell", step.alias("step")), [*keys, "cell"]).select(
        *keys, "cell", ring(F.col("r")).alias("ring"), F.col("run_id").alias("near_id"), F.col("truth_set").alias("near_set"), F.col("x").alias("near_x"))
    seen = test.join(cells, keys).withColumns({"d": distance(F.col("x"), F.col("centre")), "step": step})
    # A hair of slack keeps the bound safe against rounding.
    bound = seen.groupBy(*keys, "run_id").agg((F.min(F.col("d") + F.col("r_min")) * (1 + 1e-9) + 1e-9).alias("bound"))
    low, high = F.greatest(F.col("d") - F.col("bound"), F.col("r_min")), F.least(F.col("d") + F.col("bound"), F.col("r_max"))
    open_rings = seen.join(bound, [*keys, "run_id"]).where(low <= high + F.col("step")).withColumn(
        "ring", F.explode(F.sequence(F.greatest(ring(low) - 1, F.lit(0)), F.greatest(ring(high) + 1, F.lit(0)))))
    pairs = open_rings.select(*_with_run(keys), "degree", "truth_set", *LABELS, "x", "cell", "ring").join(placed, [*keys, "cell", "ring"])
    best = pairs.groupBy(*_with_run(keys), "degree", "truth_set", *LABELS).agg(
        F.min(F.struct(distance(F.col("x"), F.col("near_x")).alias("d"), F.col("near_id"), F.col("near_set"))).alias("b"))
    return best.select(*_with_run(keys), "degree", "truth_set", *LABELS, F.col("b.near_set").alias("predicted_set"),
                       F.col("b.near_id").alias("neighbour_id"), (-F.col("b.d")).alias("score"))


def predictions_from_key(scored: DataFrame, method: str) -> DataFrame:
    """Common prediction columns from a predicted display key."""
    has = {f"pred_{c}": F.array_contains(F.split("predicted_set", r"\+"), c).cast("int") for c in CAUSES}
    out = scored.withColumns(has).withColumn("method", F.lit(method))
    return finish_predictions(out)


def finish_predictions(df: DataFrame) -> DataFrame:
    keep = ["method", *[k for k in ("tier", "protocol", "fold") if k in df.columns], *RUN]
    count = sum((F.col(f"pred_{c}") for c in CAUSES[1:]), F.col(f"pred_{CAUSES[0]}"))
    extra = [c for c in df.columns if c == "score" or c.endswith("_score") or c == "set_margin"]
    return df.select(
        *keep, F.col("degree").alias("true_degree"), "truth_set", "predicted_set", *[F.col(f"label_{c}").alias(f"true_{c}") for c in CAUSES],
        *[f"pred_{c}" for c in CAUSES], count.alias("predicted_count"), (F.col("truth_set") == F.col("predicted_set")).cast("int").alias("correct"), *extra)


# --- evidence model -------------------------------------------------------------------------------

GROUPS = ["S", "M", "T", "X", "S_pos", "M_pos", "T_pos"]


def cause_rows(rows: DataFrame) -> DataFrame:
    """One row per cause with that cause's own label."""
    items = F.array(*[F.struct(F.lit(c).alias("cause"), F.col(f"label_{c}").alias("label")) for c in CAUSES])
    return rows.withColumn("_c", F.explode(items)).withColumns({"cause": F.col("_c.cause"), "label": F.col("_c.label")}).drop("_c")


def feature_meta(train: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """Direction, origin and scale of each (cause, feature); features that hardly separate are dropped.

    ``wanted`` lists the (cause, feature) pairs of the registry.
    """
    rows = cause_rows(train).join(F.broadcast(wanted), ["cause", "feature"])
    v, present = F.col("value"), F.col("label") == 1
    stats = rows.groupBy(*keys, "cause", "feature").agg(
        F.avg(F.when(present, v)).alias("mp"), F.avg(F.when(~present, v)).alias("ma"),
        F.stddev_samp(v).alias("gsd"), F.coalesce(F.stddev_samp(F.when(~present, v)), F.lit(0.0)).alias("asd"))
    gap = F.abs(F.col("mp") - F.col("ma"))
    kept = stats.where((F.col("gsd") >= NUMERICAL_FLOOR) & (gap >= SEPARATION * F.col("gsd")))
    return kept.select(
        *keys, "cause", "feature", F.when(F.col("mp") > F.col("ma"), 1.0).otherwise(-1.0).alias("dir"), F.col("ma").alias("mu0"),
        F.greatest(F.col("asd"), VARIANCE_FLOOR * F.col("gsd"), F.lit(NUMERICAL_FLOOR)).alias("sigma"))


def directional_z(rows: DataFrame, meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Clipped directional z per (run, cause, feature); missing values give no row."""
    z = F.col("dir") * (F.col("value") - F.col("mu0")) / F.col("sigma")
    present = rows.where("value is not null").join(meta, [*keys, "feature"])
    own = F.coalesce(*[F.when(F.col("cause") == c, F.col(f"label_{c}")) for c in CAUSES])
    return present.withColumns({"z": clip(z, -Z_LIMIT, Z_LIMIT), "label": own})


def group_scores(z: DataFrame, keys: Sequence[str], registry: DataFrame) -> DataFrame:
    """Mean z per channel, then per group; contradiction from the M channels; nonnegative twins."""
    who = [*_with_run(keys), "role", "degree", "truth_set", *LABELS, "cause", "label", "f3"]
    pos = F.greatest(F.lit(0.0), F.col("z"))
    chan = z.join(F.broadcast(registry), ["cause", "feature"]).groupBy(*who, "grp", "channel").agg(
        F.avg("z").alias("a"), F.avg(pos).alias("p"), F.avg(F.greatest(F.lit(0.0), -F.col("z"))).alias("x"))
    of = lambda g, col: F.avg(F.when(F.col("grp") == g, F.col(col)))
    return chan.groupBy(*who).agg(
        *[of(g, "a").alias(g) for g in "SMT"], of("M", "x").alias("X"), *[of(g, "p").alias(f"{g}_pos") for g in "SMT"])


def group_stats(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and floored SD of each group score over training rows where the cause is absent."""
    absent = F.col("label") == 0
    aggs = []
    for g in GROUPS:
        v = F.when(absent, F.col(g))
        aggs += [F.avg(v).alias(f"{g}_mu"), F.greatest(
            F.coalesce(F.stddev_samp(v), F.lit(0.0)), VARIANCE_FLOOR * F.coalesce(F.stddev_samp(g), F.lit(0.0)), F.lit(NUMERICAL_FLOOR)).alias(f"{g}_sg")]
    return train.groupBy(*keys, "cause", "f3").agg(*aggs)


def with_group_stats(scores: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.join(stats, [*keys, "cause", "f3"]).withColumns({f"{g}_norm": (F.col(g) - F.col(f"{g}_mu")) / F.col(f"{g}_sg") for g in GROUPS}).drop(
        *[f"{g}_{s}" for g in GROUPS for s in ("mu", "sg")])


def normalized_groups(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each group score against its training distribution where the cause is absent."""
    return with_group_stats(scores, group_stats(scores.where("role = 'train'"), keys), keys)


def evidence(norm: DataFrame) -> DataFrame:
    """Evidence E of every variant, as rows."""
    n = lambda g: F.col(f"{g}_norm")
    support = mean_of_present(n("S"), n("M"), n("T"))
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    full = zero(support) - F.coalesce(n("X"), F.lit(0.0))
    plain = F.array(
        F.struct(F.lit("D4-S").alias("method"), zero(n("S")).alias("E")),
        F.struct(F.lit("D4-SM").alias("method"), zero(mean_of_present(n("S"), n("M"))).alias("E")),
        F.struct(F.lit("D4-SMT").alias("method"), zero(mean_of_present(n("S_pos"), n("M_pos"), n("T_pos"))).alias("E")),
        F.struct(F.lit("D4-FULL").alias("method"), full.alias("E")),
    )
    direct = F.array(F.struct(F.lit("D4-FULL-F3").alias("method"), full.alias("E")))
    return norm.withColumn("_v", F.explode(F.when(F.col("f3") == 1, direct).otherwise(plain))).withColumns(
        {"method": F.col("_v.method"), "E": F.col("_v.E")}).drop("_v", "f3")


def thresholds(train: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.95,), hot_rows: int | None = None) -> DataFrame:
    """Threshold of each cause: a quantile of absent training evidence. Several quantiles become rows."""
    who = [*keys, "method", "cause"]
    names = {f"_q{i}": q for i, q in enumerate(quantiles)}
    tau = grouped_stats(train.where("label = 0"), who, (), {"E": names}, hot_rows)
    stacked = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(n).alias("tau")) for n, q in names.items()]))
    return tau.select(*who, stacked.alias("t")).select(*who, "t.q", "t.tau")


def over_thresholds(ev: DataFrame, tau: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ev.join(tau, [*keys, "method", "cause"]).withColumn("margin", F.col("E") - F.col("tau"))


def with_margins(ev: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.95,), hot_rows: int | None = None) -> DataFrame:
    return over_thresholds(ev, thresholds(ev.where("role = 'train'"), keys, quantiles, hot_rows), keys)


def ranked_sets(margins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All candidate sets of a run ordered by score, size and key, as one small array.

    There are eleven sets, so the ranking is an array sort inside the row rather than a cross join.
    """
    who = [*_with_run(keys), "q", "method", "role", "degree", "truth_set", *LABELS]
    return with_ranks(margins.groupBy(*who).agg(*[F.max(F.when(F.col("cause") == c, F.col("margin"))).alias(f"m_{c}") for c in CAUSES]))


def with_ranks(wide: DataFrame) -> DataFrame:
    """``ranked_sets`` of rows that hold the margins of all causes."""
    return wide.withColumn("ranked", set_order({c: F.col(f"m_{c}") for c in CAUSES})).withColumns({
        "predicted_set": F.get("ranked", F.lit(0))["cause_set"],
        "set_margin": F.get("ranked", F.lit(1))["neg"] - F.get("ranked", F.lit(0))["neg"],
    })


def set_order(margins: dict[str, Column]) -> Column:
    """The candidate sets as an array, best first, from the margin of each cause; a missing one counts as zero."""
    m = {c: F.coalesce(v, F.lit(0.0)) for c, v in margins.items()}

    def score(members):
        total = F.lit(0.0)
        for c in members:
            total = total + m[c]
        for c in CAUSES:
            if c not in members:
                total = total - F.greatest(F.lit(0.0), m[c])
        return total

    sets = F.array(*[
        F.struct((-score(s)).alias("neg"), F.lit(len(s)).alias("size"), F.lit("+".join(s) if s else "NONE").alias("cause_set")) for s in CAUSE_SETS])
    return F.array_sort(sets)


def cause_ranks(margins: DataFrame) -> DataFrame:
    """Rank of each cause by margin, ties in cause order."""
    wide = F.array(*[F.struct((-F.coalesce(F.col(f"m_{c}"), F.lit(0.0))).alias("neg"), F.lit(i).alias("i"), F.lit(c).alias("cause")) for i, c in enumerate(CAUSES)])
    return margins.select("*", F.posexplode(F.array_sort(wide)).alias("_p", "_c")).withColumns(
        {"cause": F.col("_c.cause"), "margin": -F.col("_c.neg"), "rank": F.col("_p") + 1}).drop("_p", "_c")


# A run's features stay one array, and a fold's statistics arrays beside it: rows multiply by folds only, not by folds,
# causes, features and channels, and what is shuffled is one row a (run, fold).

#: (cause, feature) pairs of the registry, the features they read, and the (direct evidence, cause) scores.
PAIRS = list(dict.fromkeys((c, f) for _, c, _, _, f in evidence_rows()))
PAIR_FEATURES = sorted({f for _, f in PAIRS})
SCORES = [(f3, c) for f3 in (0, 1) for c in CAUSES]
META = ["dir", "mu0", "sigma"]


def _channels(f3: int, cause: str, group: str) -> list[list[int]]:
    """Positions in ``PAIRS`` of each channel's features."""
    out: dict[str, list[int]] = {}
    for v, c, g, channel, feature in evidence_rows():
        if (v, c, g) == (f3, cause, group):
            out.setdefault(channel, []).append(PAIRS.index((c, feature)))
    return list(out.values())


def feature_vectors(long: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per run (and further keys) with its features as an array, missing ones null."""
    entries = [F.max(F.when(F.col("feature") == f, F.col("value"))) for f in features]
    return long.groupBy(*_with_run(keys), "degree", "truth_set", *LABELS).agg(F.array(*entries).alias("x"))


def meta_vectors(meta: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]] = PAIRS) -> DataFrame:
    """Direction, origin and scale of all pairs as arrays, one row a model; null where a pair is dropped."""
    at = lambda c, f: (F.col("cause") == c) & (F.col("feature") == f)
    return meta.groupBy(*keys).agg(*[F.array(*[F.max(F.when(at(*p), F.col(m))) for p in pairs]).alias(m) for m in META])


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and presence of an array column of one length."""
    flat = column.flatten()
    present = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
    return flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width), present


def _mean(values: list[np.ndarray], present: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the present values of each row, and whether there is any."""
    n = sum(p.astype(float) for p in present)
    total = sum(np.where(p, v, 0.0) for v, p in zip(values, present))
    return np.divide(total, n, out=np.zeros_like(total, dtype=float), where=n > 0), n > 0


def _score_plan() -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Which rows make up each channel's mean, which channels each group's, and the group behind each column of scores.

    Rows are the pairs' z, then their positive, then their negative parts. Longer channels and groups come first, so that the
    k-th array adds the k-th member to all that have one. Channels and groups that scores share stand once.
    """
    wanted = [(g[0] if g != "X" else "M", g[1:] if g != "X" else "X") for g in GROUPS]
    shift = {"": 0, "_pos": len(PAIRS), "X": 2 * len(PAIRS)}
    groups = [tuple(tuple(shift[form] + i for i in ch) for ch in _channels(*score, group)) for score in SCORES for group, form in wanted]
    ordered = sorted(dict.fromkeys(groups), key=len, reverse=True)
    channels = sorted(dict.fromkeys(ch for g in ordered for ch in g), key=len, reverse=True)
    at = {ch: i for i, ch in enumerate(channels)}
    level = lambda lists, k: np.array([m[k] for m in lists if len(m) > k])
    members = [[at[ch] for ch in g] for g in ordered]
    return ([level(channels, k) for k in range(len(channels[0]))], [level(members, k) for k in range(len(members[0]))], np.array([ordered.index(g) for g in groups]))


_SCORE_PLAN = _score_plan()


def _level_means(rows: np.ndarray, weights: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Means of rows that are zero where their weight is zero, members added in order, and 1 where there is any."""
    total, n = rows[levels[0]], weights[levels[0]]
    for members in levels[1:]:
        total[:len(members)] += rows[members]
        n[:len(members)] += weights[members]
    total /= np.maximum(n, 1.0)
    return total, (n > 0).astype(float)


def _score_matrix(z: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns of ``GROUPS`` for each of ``SCORES``: means per channel, then per group. ``z`` is zero where not present."""
    channels, groups, place = _SCORE_PLAN
    held, there = np.ascontiguousarray(z.T), np.ascontiguousarray(present.T).astype(float)
    means, some = _level_means(np.concatenate([held, np.maximum(0.0, held), np.maximum(0.0, -held)]), np.concatenate([there] * 3), channels)
    values, known = _level_means(means, some, groups)
    return np.ascontiguousarray(values[place].T), np.ascontiguousarray(known[place].T) > 0


def _plain_matrix(z: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S, M, T and X of each cause: means over a group's features."""
    values, there = [], []
    for cause in CAUSES:
        for group, form in (("S", z), ("M", z), ("T", z), ("M", np.maximum(0.0, -z))):
            own = [i for i, (c, g, _) in enumerate(plain_group_rows()) if (c, g) == (cause, group)]
            value, any_ = _mean([form[:, i] for i in own], [present[:, i] for i in own])
            values.append(value)
            there.append(any_)
    return np.stack(values, axis=1), np.stack(there, axis=1)


def vector_scores(rows: DataFrame, features: Sequence[str], pairs: Sequence[tuple[str, str]] = PAIRS, means=_score_matrix) -> DataFrame:
    """``group_scores`` of rows that hold features ``x`` and the arrays of ``meta_vectors``, as one array ``g`` a row."""
    place = [list(features).index(f) for _, f in pairs]
    kept = [c for c in rows.columns if c not in ("x", *META)]
    schema = StructType([rows.schema[c] for c in kept]).add("g", ArrayType(DoubleType()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, there = _matrix(batch.column("x"), len(features))
            (sign, known), (mu0, _), (sigma, _) = (_matrix(batch.column(m), len(pairs)) for m in META)
            present = there[:, place] & known
            with np.errstate(all="ignore"):
                z = sign * (x[:, place] - mu0) / np.where(present, sigma, 1.0)
            # as in SQL, a value that is no number counts as the largest
            z = np.where(present, np.clip(np.where(np.isnan(z), Z_LIMIT, z), -Z_LIMIT, Z_LIMIT), 0.0)
            values, any_ = means(z, present)
            flat = pa.array(values.ravel(), mask=~any_.ravel())
            ends = pa.array(np.arange(0, flat.__len__() + 1, values.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.ListArray.from_arrays(ends, flat)], names=[*kept, "g"])

    return rows.mapInArrow(score, schema)


def score_rows(vectors: DataFrame) -> DataFrame:
    """The array ``g`` as rows of ``group_scores``; scores without any feature give no row."""
    entry = lambda k, f3, c: F.struct(F.lit(c).alias("cause"), F.col(f"label_{c}").alias("label"), F.lit(f3).alias("f3"), *[
        F.get("g", F.lit(k * len(GROUPS) + i)).alias(g) for i, g in enumerate(GROUPS)])
    some = F.coalesce(*[F.col(f"_s.{g}") for g in "SMT"]).isNotNull()
    each = vectors.withColumn("_s", F.explode(F.array(*[entry(k, *s) for k, s in enumerate(SCORES)]))).where(some)
    return each.select(*[c for c in vectors.columns if c != "g"], "_s.*")


def packed_norms(vectors: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``with_group_stats`` on vectors: the scores of a row as an array ``n`` of structs."""
    parts = [f"{g}_{s}" for g in GROUPS for s in ("mu", "sg")]
    of = lambda f3, c: F.max(F.when((F.col("cause") == c) & (F.col("f3") == f3), F.struct(*parts)))
    wide = stats.groupBy(*keys).agg(*[of(*s).alias(f"_w{k}") for k, s in enumerate(SCORES)])

    def entry(k, f3, c):
        g = {n: F.get("g", F.lit(k * len(GROUPS) + i)) for i, n in enumerate(GROUPS)}
        fields = [F.lit(c).alias("cause"), F.col(f"label_{c}").alias("label"), F.lit(f3).alias("f3"), *[g[n].alias(n) for n in "SMTX"], *[
            ((g[n] - F.col(f"_w{k}.{n}_mu")) / F.col(f"_w{k}.{n}_sg")).alias(f"{n}_norm") for n in GROUPS]]
        return F.when(F.coalesce(*[g[n] for n in "SMT"]).isNotNull() & F.col(f"_w{k}").isNotNull(), F.struct(*fields))

    held = [c for c in vectors.columns if c != "g"]
    return vectors.join(wide, list(keys)).select(*held, F.array_compact(F.array(*[entry(k, *s) for k, s in enumerate(SCORES)])).alias("n"))


def unpacked(packed: DataFrame) -> DataFrame:
    """Evidence rows of packed norms."""
    rows = packed.withColumn("_n", F.explode("n")).drop("n")
    return evidence(rows.select(*[c for c in rows.columns if c != "_n"], "_n.*"))


def packed_thresholds(packed: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.95,), hot_rows: int | None = None) -> DataFrame:
    """Thresholds of a model as one row, array ``cuts``."""
    tau = thresholds(unpacked(packed.where("role = 'train'")).select(*keys, "method", "cause", "label", "E"), keys, quantiles, hot_rows)
    return tau.groupBy(*keys).agg(F.collect_list(F.struct("method", "cause", "q", "tau")).alias("cuts"))


def packed_margins(packed: DataFrame, taus: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``over_thresholds`` on packed norms: joined a row a (run, fold), unpacked after."""
    ev = unpacked(packed.join(taus, list(keys)))
    own = F.filter("cuts", lambda e: (e["method"] == F.col("method")) & (e["cause"] == F.col("cause")))
    rows = ev.withColumn("_t", F.explode(own)).withColumns({"q": F.col("_t.q"), "tau": F.col("_t.tau")}).drop("cuts", "_t")
    return rows.withColumn("margin", F.col("E") - F.col("tau"))


def fold_meta(long: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """``feature_meta`` of every leave-one-repetition-out fold from the runs' rows (P1).

    Rows are dealt by campaign and feature before they multiply by folds and causes, so that only the runs' rows are shuffled.
    """
    rest = [k for k in keys if k != "fold"]
    rows = long.select(*rest, "repetition", "degree", *LABELS, "feature", "value")
    folds = rows.groupBy("campaign_id").agg(F.collect_set("repetition").alias("_folds"))
    dealt = rows.where("degree <= 1").repartition("campaign_id", "feature").join(F.broadcast(folds), "campaign_id")
    grown = dealt.withColumn("fold", F.explode("_folds")).drop("_folds").where("fold <> repetition")
    return feature_meta(grown, keys, wanted)


def _with_meta(long: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], features: Sequence[str]) -> DataFrame:
    """Every run's features as an array in each of its folds, beside the arrays of that fold's statistics."""
    rest = [k for k in keys if k != "fold"]
    wanted = long.sparkSession.createDataFrame(list(pairs), "cause string, feature string")
    meta = pin(meta_vectors(fold_meta(long, keys, wanted), keys, pairs))
    runs = feature_vectors(long.where(F.col("feature").isin(*features)), rest, features)
    return _in_folds(runs.repartition("campaign_id").join(meta, rest), "P1")


def train_evidence(long: DataFrame, keys: Sequence[str] = ("campaign_id", "fold")) -> DataFrame:
    """Packed evidence of every train and test row under statistics of its fold's training rows (P1).

    ``long`` has labelled runs, one row a feature; the folds of a campaign are its repetitions.
    """
    keys = list(keys)
    grown = _with_meta(long, keys, PAIRS, PAIR_FEATURES)
    scores = pin(vector_scores(grown, PAIR_FEATURES))
    return packed_norms(scores, group_stats(score_rows(scores.where("role = 'train'")), keys), keys)


# A degraded run is scored inside its own row, beside the arrays of its model, so that points of a grid multiply rows after
# the last shuffle.

#: Keys of the declared cause sets in the order in which ties between centroids fall.
CELLS = sorted("+".join(s) if s else "NONE" for s in CAUSE_SETS)
FULL_METHODS = ("D4-FULL", "D4-FULL-F3")


def model_widths(width: int) -> dict[str, int]:
    """Length of each array of ``model_vectors``; ``width`` is that of a centroid."""
    scores = len(SCORES) * len(GROUPS)
    return {m: len(PAIRS) for m in META} | {"stat_mu": scores, "stat_sg": scores, "tau": len(SCORES)} | {m: width for m in ("fill", "scale_mu", "scale_sd")} | {
        "centres": len(CELLS) * width}


def model_vectors(meta: DataFrame, stats: DataFrame, tau: DataFrame, scale: DataFrame, centre: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Everything fitted as one row a model: arrays of directions, group statistics, thresholds, scaling and centroids."""
    keys, width = list(keys), len(features)
    nulls = lambda n: F.array_repeat(F.lit(None).cast("double"), n)
    own = [(F.col("cause") == c) & (F.col("f3") == f3) for f3, c in SCORES]
    spread = stats.groupBy(*keys).agg(*[
        F.array(*[F.max(F.when(hit, F.col(f"{g}_{part}"))) for hit in own for g in GROUPS]).alias(f"stat_{part}") for part in ("mu", "sg")])
    cuts = tau.groupBy(*keys).agg(F.array(*[
        F.max(F.when((F.col("cause") == c) & (F.col("method") == FULL_METHODS[f3]), F.col("tau"))) for f3, c in SCORES]).alias("tau"))
    at = lambda c: F.array(*[F.max(F.when(F.col("feature") == f, F.col(c))) for f in features])
    scales = scale.groupBy(*keys).agg(at("fill").alias("fill"), at("mu").alias("scale_mu"), at("sd").alias("scale_sd"))
    cells = centre.groupBy(*keys).agg(F.flatten(F.array(*[
        F.coalesce(F.max(F.when(F.col("cell") == c, F.col("centre"))), nulls(width)) for c in CELLS])).alias("centres"))
    out = scales
    for part in (cells, meta_vectors(meta, keys), spread, cuts):
        out = out.join(part, keys, "left")
    return out.select(*keys, *[F.coalesce(c, nulls(n)).alias(c) for c, n in model_widths(width).items()])


def _nearest_cell(x: np.ndarray, there: np.ndarray, model: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``CELLS`` of the closest centroid of each row, and whether there is any. Arrays of ``model`` have a row each or one for all."""
    (fill, filled), (mu, _), (sd, scaled) = model["fill"], model["scale_mu"], model["scale_sd"]
    z = (np.where(there, x, fill) - mu) / np.where(scaled, sd, 1.0)
    known = (there | filled) & scaled
    centres, held = (a.reshape(-1, len(CELLS), width) for a in model["centres"])
    gap = np.where(known[:, None, :] & held, (z[:, None, :] - centres) ** 2, 0.0)
    some = held.any(axis=2)
    d = np.where(some, np.sqrt(gap.sum(axis=2)), np.inf)
    return d.argmin(axis=1), np.broadcast_to(some.any(axis=1), len(x))


def _full_margins(x: np.ndarray, there: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Full evidence over its threshold for each of ``SCORES``, and where it exists."""
    (sign, known), (mu0, _), (sigma, _) = (model[m] for m in META)
    present = there & known
    z = sign * (x - mu0) / np.where(present, sigma, 1.0)
    z = np.where(present, np.clip(np.where(np.isnan(z), Z_LIMIT, z), -Z_LIMIT, Z_LIMIT), 0.0)
    value, any_ = (a.reshape(len(x), len(SCORES), len(GROUPS)) for a in _score_matrix(z, present))
    (mu, has_mu), (sg, has_sg), (tau, cut) = ((a.reshape(len(a), len(SCORES), -1) for a in model[m]) for m in ("stat_mu", "stat_sg", "tau"))
    norm, there_n = (value - mu) / np.where(has_sg, sg, 1.0), any_ & has_mu & has_sg
    support, _ = _mean([norm[..., i] for i in range(3)], [there_n[..., i] for i in range(3)])
    e = support - np.where(there_n[..., 3], norm[..., 3], 0.0)
    return e - tau[..., 0], any_[..., :3].any(axis=2) & has_sg.any(axis=2) & cut[..., 0]


def scored_points(rows: DataFrame, features: Sequence[str], centroid_features: Sequence[str]) -> DataFrame:
    """``cell``, the set of the closest centroid, and ``margins`` over ``SCORES`` of rows that hold features ``x`` and the
    arrays of ``model_vectors``; both null where there is none."""
    features, width = list(features), len(centroid_features)
    near, place = [features.index(f) for f in centroid_features], [features.index(f) for _, f in PAIRS]
    widths = model_widths(width)
    kept = [c for c in rows.columns if c != "x" and c not in widths]
    schema = StructType([rows.schema[c] for c in kept]).add("cell", "string").add("margins", ArrayType(DoubleType()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, there = _matrix(batch.column("x"), len(features))
            model = {m: _matrix(batch.column(m), n) for m, n in widths.items()}
            with np.errstate(all="ignore"):
                cell, found = _nearest_cell(x[:, near], there[:, near], model, width)
                margin, has = _full_margins(x[:, place], there[:, place], model)
            flat = pa.array(margin.ravel(), mask=~has.ravel())
            ends = pa.array(np.arange(0, len(flat) + 1, len(SCORES), dtype=np.int32))
            cells = pa.array([CELLS[i] if ok else None for i, ok in zip(cell, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], cells, pa.ListArray.from_arrays(ends, flat)], names=[*kept, "cell", "margins"])

    return rows.mapInArrow(score, schema)


def point_sets(scored: DataFrame) -> DataFrame:
    """One row per method with its predicted set, from ``scored_points``."""
    margin = lambda f3: {c: F.get("margins", F.lit(SCORES.index((f3, c)))) for c in CAUSES}
    best = lambda m: F.when(F.coalesce(*m.values()).isNotNull(), F.get(set_order(m), F.lit(0))["cause_set"])
    named = [F.struct(F.lit("M1/F2").alias("method"), F.col("cell").alias("predicted_set")), *[
        F.struct(F.lit(name).alias("method"), best(margin(f3)).alias("predicted_set")) for f3, name in enumerate(FULL_METHODS)]]
    each = scored.withColumn("_p", F.explode(F.array(*named)))
    return each.select(*[c for c in scored.columns if c not in ("cell", "margins")], "_p.*").where("predicted_set is not null")


def plain_evidence(long: DataFrame, keys: Sequence[str] = ("campaign_id", "fold")) -> DataFrame:
    """The earlier flavour: feature means per group, no channels and no normalisation."""
    pairs = [(c, f) for c, _, f in plain_group_rows()]
    features = sorted({f for _, f in pairs})
    scores = pin(vector_scores(_with_meta(long, list(keys), pairs, features), features, pairs, _plain_matrix))
    entry = lambda k, c: F.struct(F.lit(c).alias("cause"), F.col(f"label_{c}").alias("label"), *[F.get("g", F.lit(4 * k + i)).alias(g) for i, g in enumerate("SMTX")])
    each = scores.withColumn("_s", F.explode(F.array(*[entry(k, c) for k, c in enumerate(CAUSES)]))).where("coalesce(_s.S, _s.M, _s.T) is not null")
    out = each.select(*[c for c in scores.columns if c != "g"], "_s.*")
    e = F.coalesce(mean_of_present(F.col("S"), F.col("M"), F.col("T")), F.lit(0.0)) - F.coalesce(F.col("X"), F.lit(0.0))
    return out.withColumns({"method": F.lit("RAW-FULL"), "E": e})


def evidence_predictions(ranked: DataFrame) -> DataFrame:
    has = {f"pred_{c}": F.array_contains(F.split("predicted_set", r"\+"), c).cast("int") for c in CAUSES}
    return finish_predictions(ranked.where("role = 'test'").withColumns(has))
