"""Queries over degraded telemetry, pairing with controls, cost and design."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.core import unpivot
from ..operators import cost as K
from ..operators import degrade as R
from ..operators import derive as D
from ..operators import design as DS
from ..operators import diagnose as G
from ..operators import features as FT
from ..operators import joins as J
from ..operators import pairs as P
from ..operators import scoring as S
from ..operators.grouped import grouped_stats, sized_broadcast
from ..session import pin
from ..sources.driver_views import RUN
from . import tables as V
from .diagnosis_oracle import CAUSE_DOUBLES, PRED_COLS, WHO, cause_metrics_sql, mean_present, names, ranked_sql, set_metrics_sql
from .diagnosis_queries import domains, features
from .oracle import RUN as RUN_SQL
from .oracle import TABLES, t_half, uniform, values
from .registry import query
from .temporal_queries import delayed_order, sampled_order

POINT = ["family", "severity", "seed", "lost"]
#: A model belongs to a pair of campaigns (source, target) and a fold of the source; fold 0 leaves nothing out and serves the target.
MODEL = ["pair_id", "fold"]
CHANNELS = list(FT.LOST_CHANNELS)
# Seeds of the source campaign's realisations; the target's are a hundred higher.
MISSING_SEEDS, SAMPLING_SEEDS, NOISE_SEEDS = tuple(range(8101, 8111)), tuple(range(8301, 8311)), tuple(range(8501, 8511))
ALL_FEATURES = sorted({*FT.F2T, *FT.F3, *FT.PREFILL})

# Reference tables. Training rows are the clean runs of the source with at most one cause; test rows stand once a point of the grid.
_PAIR = "CAST(floor(campaign_id / 2) AS BIGINT)"
_POINTS = "family, severity, seed, lost"
_NONE = "CAST(NULL AS DOUBLE) AS severity, CAST(NULL AS INT) AS seed, CAST(NULL AS VARCHAR) AS lost"
_SHIFTED = "+ CAST(100 * (campaign_id % 2) AS INT)"
WHO_R = f"pair_id, {WHO}, {_POINTS}"
TABLES["rtrain"] = f"""SELECT l.*, {_PAIR} AS pair_id, fold, 'train' AS role, 'train' AS family, {_NONE} FROM labf l, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS fold)
  WHERE campaign_id % 2 = 0 AND degree <= 1 AND fold <> repetition"""
TABLES["rtest"] = f"SELECT *, {_PAIR} AS pair_id, CASE WHEN campaign_id % 2 = 0 THEN repetition ELSE 0 END AS fold, 'test' AS role FROM labf"
_levels = lambda levels: "[" + ", ".join(f"{x}::DOUBLE" for x in levels) + "]"
_seeds = lambda seeds: "[" + ", ".join(map(str, seeds)) + "]"
TABLES["rmiss"] = f"""SELECT * REPLACE (CASE WHEN {uniform('CAST(seed AS VARCHAR)', 'run_id', 'feature')} >= severity THEN value END AS value) FROM (
  SELECT t.*, 'missingness' AS family, severity, s {_SHIFTED} AS seed, CAST(NULL AS VARCHAR) AS lost FROM rtest t, (SELECT unnest({_levels(R.MISSING_LEVELS)}) AS severity), (SELECT unnest({_seeds(MISSING_SEEDS)}) AS s))"""
_u1 = f"greatest({uniform('CAST(seed AS VARCHAR)', 'run_id', 'feature', repr('a'))}, 1e0 / 4294967296e0)"
_u2 = uniform("CAST(seed AS VARCHAR)", "run_id", "feature", repr("b"))
TABLES["rsd"] = "SELECT pair_id, feature, stddev_samp(value) AS noise_sd FROM rtrain WHERE fold = 0 GROUP BY ALL"
TABLES["rnoise"] = f"""SELECT * EXCLUDE (noise_sd, noisy) REPLACE (CASE WHEN noise_sd * severity > 0 AND value IS NOT NULL THEN
    CASE WHEN regexp_matches(feature, '{"|".join(FT.NONNEGATIVE_TOKENS)}') THEN greatest(0, noisy) ELSE noisy END ELSE value END AS value)
  FROM (SELECT *, value + noise_sd * severity * (sqrt(-2 * ln({_u1})) * cos(6.283185307179586::DOUBLE * {_u2})) AS noisy
    FROM (SELECT t.*, 'noise' AS family, severity, s {_SHIFTED} AS seed, CAST(NULL AS VARCHAR) AS lost, d.noise_sd FROM rtest t LEFT JOIN rsd d USING (pair_id, feature),
      (SELECT unnest({_levels(R.NOISE_LEVELS)}) AS severity), (SELECT unnest({_seeds(NOISE_SEEDS)}) AS s)))"""
TABLES["rloss"] = f"""SELECT t.* REPLACE (CASE WHEN h.lost IS NULL THEN value END AS value), 'channel_loss' AS family, CAST(NULL AS DOUBLE) AS severity, CAST(NULL AS INT) AS seed, c.lost
  FROM rtest t CROSS JOIN (SELECT unnest([{names(CHANNELS)}]) AS lost) c LEFT JOIN ({values([(c, f) for c in CHANNELS for f in FT.LOST_CHANNELS[c]], 'lost, feature')}) h ON h.lost = c.lost AND h.feature = t.feature"""
_temporal = names(FT.TEMPORAL)
_replaced = lambda family, on: f"""SELECT t.* REPLACE (CASE WHEN t.feature IN ({_temporal}) THEN q.value ELSE t.value END AS value), '{family}' AS family, g.severity, g.seed, CAST(NULL AS VARCHAR) AS lost
  FROM rtest t JOIN (SELECT DISTINCT run_id, severity, seed FROM {on}) g USING (run_id) LEFT JOIN (SELECT run_id, severity, seed, metric || '_' || stat AS feature, value FROM {on}
    UNPIVOT INCLUDE NULLS (value FOR stat IN ({', '.join(FT.WINDOW_STATS)}))) q ON q.run_id = t.run_id AND q.severity = g.severity AND q.seed = g.seed AND q.feature = t.feature"""  # noqa: E731
TABLES["rsamp"] = _replaced("temporal_sampling", "osamp")
TABLES["rdelay"] = _replaced("delay", "odelay").replace("g.seed, CAST", "CAST(NULL AS INT) AS seed, CAST")
TABLES["rdeg"] = f"""SELECT *, 'clean' AS family, {_NONE} FROM rtest UNION ALL BY NAME SELECT * FROM rmiss UNION ALL BY NAME SELECT * FROM rnoise UNION ALL BY NAME SELECT * FROM rloss
  UNION ALL BY NAME SELECT * FROM rsamp UNION ALL BY NAME SELECT * FROM rdelay"""
TABLES["rspl"] = "SELECT * FROM rtrain UNION ALL BY NAME SELECT * FROM rdeg"
_MIRROR = ["spl", "sp2", "fills", "scal", "zz", "cent", "crow", "meta", "dz", "chan", "gsc", "gst", "gno"]


def _mirrored(sql: str) -> str:
    """A plain table's text over the grid's rows: keyed by the model, with the point of each row."""
    sql = sql.replace(WHO, "@").replace("campaign_id, fold", "pair_id, fold").replace("@", WHO_R)
    for name in _MIRROR:
        sql = re.sub(rf"\b{name}\b", f"r{name}", sql)
    return sql


for _name in _MIRROR[1:]:
    TABLES[f"r{_name}"] = _mirrored(TABLES[_name])
TABLES["rctr"] = f"""SELECT {WHO_R}, fold, 'M1/F2' AS method, cell AS predicted_set FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, fold, {_POINTS} ORDER BY d, cell) AS k FROM (
    SELECT {', '.join('t.' + x.strip() for x in WHO_R.split(','))}, t.fold, c.cell, sqrt(sum((t.z - c.c) * (t.z - c.c))) AS d
    FROM rzz t JOIN rcent c ON c.pair_id = t.pair_id AND c.fold = t.fold AND c.feature = t.feature WHERE t.role = 'test' GROUP BY ALL)) WHERE k = 1"""
_full = f"{mean_present('S_norm', 'M_norm', 'T_norm')} - coalesce(X_norm, 0)"
TABLES["revid"] = f"SELECT *, 'D4-FULL' AS method, {_full} AS E FROM rgno WHERE f3 = 0 UNION ALL SELECT *, 'D4-FULL-F3', {_full} FROM rgno WHERE f3 = 1"
TABLES["rtau"] = "SELECT pair_id, fold, method, cause, 0.95::DOUBLE AS q, quantile_cont(E, 0.95) AS tau FROM revid WHERE role = 'train' AND label = 0 GROUP BY ALL"
TABLES["rmarg"] = "SELECT e.*, t.q, t.tau, E - tau AS margin FROM revid e JOIN rtau t USING (pair_id, fold, method, cause) WHERE role = 'test'"
TABLES["rrank"] = ranked_sql("rmarg").replace(WHO, WHO_R).replace("PARTITION BY run_id, fold,", f"PARTITION BY run_id, fold, {_POINTS},").replace("mwide", "rwide")
TABLES["rpred"] = f"""SELECT method, {_POINTS}, {PRED_COLS} FROM (SELECT {WHO_R}, fold, method, predicted_set FROM rctr UNION ALL SELECT {WHO_R}, fold, method, cause_set FROM rrank WHERE rank = 1)
  WHERE lost IS NULL OR NOT (lost LIKE 'C8%' AND method NOT LIKE 'D4%' OR lost LIKE 'C9%' AND method <> 'D4-FULL-F3')"""
TABLES["rdegraded"] = "SELECT * FROM rpred WHERE family <> 'clean'"
TABLES["rclean"] = "SELECT * FROM rpred WHERE family = 'clean'"


def _retention_sql() -> str:
    block = lambda src, keys: f"""SELECT a.*, b.control_false_alarm_rate AS alarm FROM ({set_metrics_sql(f"(SELECT * FROM {src} WHERE true_degree = 2)", keys)}) a
      JOIN ({set_metrics_sql(src, keys)}) b ON {' AND '.join(f'a.{k.strip()} IS NOT DISTINCT FROM b.{k.strip()}' for k in keys.split(','))}"""
    return f"""SELECT g.campaign_id, g.method, g.family, g.severity, g.seed, g.lost, g.exact_set_accuracy AS compound_exact, g.complete_cause_recall, g.jaccard, g.macro_f1, g.over_attribution, g.under_attribution,
      g.alarm AS control_false_alarm_rate, c.exact_set_accuracy AS clean_exact, c.alarm AS clean_alarm, CASE WHEN c.exact_set_accuracy > 0 THEN g.exact_set_accuracy / c.exact_set_accuracy END AS retention,
      c.exact_set_accuracy - g.exact_set_accuracy AS absolute_loss, g.alarm - c.alarm AS control_false_alarm_change
    FROM ({block('rdegraded', f'campaign_id, method, {_POINTS}')}) g JOIN ({block('rclean', 'campaign_id, method')}) c USING (campaign_id, method)"""


TABLES["gret"] = _retention_sql()


def labelled_runs(spark, sf):
    return G.labelled(features(spark, sf)).withColumn("pair_id", F.floor(F.col("campaign_id") / 2).cast("bigint"))


def training_rows(spark, sf):
    """Source runs of at most one cause, once a fold that they train; fold 0 takes all."""
    source = labelled_runs(spark, sf).where("campaign_id % 2 = 0")
    folds = source.select("pair_id", "repetition").distinct().groupBy("pair_id").agg(F.array_union(F.array(F.lit(0)), F.collect_set("repetition")).alias("_folds"))
    dealt = source.where("degree <= 1").repartition("pair_id", "feature")
    grown = dealt.join(F.broadcast(folds), "pair_id").withColumn("fold", F.explode("_folds")).drop("_folds")
    return grown.where("fold <> repetition").withColumn("role", F.lit("train"))


def test_rows(spark, sf):
    fold = F.when(F.col("campaign_id") % 2 == 0, F.col("repetition")).otherwise(0)
    return labelled_runs(spark, sf).withColumns({"fold": fold, "role": F.lit("test")})


def _with_points(rows, family):
    """The columns of a point, null where the family has none."""
    kinds = {"family": "string", "severity": "double", "seed": "int", "lost": "string"}
    missing = {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in rows.columns}
    return rows.withColumns(missing | {"family": F.lit(family)})


def _realised(rows, family, levels, seeds):
    return R.grid(rows, family, levels, seeds).withColumn("seed", (F.col("seed") + 100 * (F.col("campaign_id") % 2)).cast("int"))


def missing_rows(spark, sf):
    return _with_points(R.random_missing(_realised(test_rows(spark, sf), "missingness", R.MISSING_LEVELS, MISSING_SEEDS)), "missingness")


def noise_sd(spark, sf):
    """SD of each feature over the training rows of fold 0, which leaves nothing out."""
    train = labelled_runs(spark, sf).where("campaign_id % 2 = 0 and degree <= 1")
    return train.groupBy("pair_id", "feature").agg(F.stddev_samp("value").alias("sd"))


def noise_rows(spark, sf):
    seeds = F.array(*[(F.lit(s) + 100 * (F.col("campaign_id") % 2)).cast("int") for s in NOISE_SEEDS])
    return _with_points(R.noise_grid(test_rows(spark, sf), noise_sd(spark, sf), ["pair_id"], R.NOISE_LEVELS, seeds), "noise")


def loss_rows(spark, sf):
    return _with_points(R.channel_loss(test_rows(spark, sf), CHANNELS), "channel_loss")


def _reordered(spark, sf, order, family, keys):
    """Test rows with the temporal features of degraded orderings in the place of their own."""
    stats = unpivot(order, [*RUN, *keys, "metric"], FT.WINDOW_STATS, "stat")
    new = stats.select("run_id", *keys, F.concat_ws("_", "metric", "stat").alias("feature"), F.col("value").alias("_new"))
    points = order.select("run_id", *keys).distinct()
    rows = test_rows(spark, sf).join(points, "run_id").join(new, ["run_id", *keys, "feature"], "left")
    return _with_points(rows.withColumn("value", F.when(F.col("feature").isin(*FT.TEMPORAL), F.col("_new")).otherwise(F.col("value"))).drop("_new"), family)


def sampling_rows(spark, sf):
    return _reordered(spark, sf, sampled_order(spark, sf), "temporal_sampling", ["severity", "seed"])


def delay_rows(spark, sf):
    return _reordered(spark, sf, delayed_order(spark, sf), "delay", ["severity"])


#: What the scored methods read of a run, and what of it comes from the order of requests.
READ = sorted({*FT.F2, *G.PAIR_FEATURES})
READ_TEMPORAL = [f for f in READ if f in FT.TEMPORAL]


def training_vectors(spark, sf):
    """Source runs of at most one cause, a row each, multiplied by the folds that they train."""
    source = labelled_runs(spark, sf).where("campaign_id % 2 = 0")
    folds = source.select("pair_id", "repetition").distinct().groupBy("pair_id").agg(F.array_union(F.array(F.lit(0)), F.collect_set("repetition")).alias("_folds"))
    runs = G.feature_vectors(source.where(F.col("feature").isin(*READ) & (F.col("degree") <= 1)), ["pair_id"], READ)
    grown = runs.join(F.broadcast(folds), "pair_id").withColumn("fold", F.explode("_folds")).drop("_folds")
    return grown.where("fold <> repetition").withColumn("role", F.lit("train"))


def evidence_model(spark, sf):
    """Directions, group scales and thresholds of every model, fitted once on clean training rows."""
    wanted = FT.evidence_registry(spark).select("cause", "feature").distinct()
    meta = V.keep("robust-meta", spark, sf, lambda: G.feature_meta(training_rows(spark, sf), MODEL, wanted))
    beside = training_vectors(spark, sf).join(G.meta_vectors(meta, MODEL), MODEL)
    scores = V.keep("robust-train", spark, sf, lambda: G.score_rows(G.vector_scores(beside, READ)))
    stats = V.keep("robust-stats", spark, sf, lambda: G.group_stats(scores, MODEL))
    tau = V.keep("robust-tau", spark, sf, lambda: G.thresholds(G.evidence(G.with_group_stats(scores, stats, MODEL)), MODEL))
    return meta, stats, tau


def centroid_model(spark, sf):
    train = training_rows(spark, sf).where(F.col("feature").isin(*FT.F2))
    scale = V.keep("robust-scale", spark, sf, lambda: G.scaling(train, MODEL))

    def centres():
        at = lambda c: F.array(*[F.max(F.when(F.col("feature") == f, F.col(c))) for f in FT.F2]).alias(c)
        wide = scale.groupBy(*MODEL).agg(*[at(c) for c in ("fill", "mu", "sd")])
        own = F.array(*[F.get("x", F.lit(READ.index(f))) for f in FT.F2])
        z = F.expr("transform(x, (v, i) -> (coalesce(v, fill[i]) - mu[i]) / sd[i])")
        return G.centroids(training_vectors(spark, sf).withColumn("x", own).join(wide, MODEL).withColumn("x", z), MODEL, len(FT.F2))

    return scale, V.keep("robust-centres", spark, sf, centres)


def models(spark, sf):
    return V.keep("robust-models", spark, sf, lambda: G.model_vectors(*evidence_model(spark, sf), *centroid_model(spark, sf), MODEL, FT.F2))


def point_vectors(spark, sf):
    """Every test run's features at every point of the grid, the clean one included, beside its model.

    Runs, models and order features meet a row a run; points multiply rows after that.
    """
    runs = G.feature_vectors(test_rows(spark, sf).where(F.col("feature").isin(*READ)), MODEL, READ)
    noise = noise_sd(spark, sf).groupBy("pair_id").agg(F.array(*[F.max(F.when(F.col("feature") == f, F.col("sd"))) for f in READ]).alias("noise_sd"))
    sampled = R.packed_orders(sampled_order(spark, sf), READ_TEMPORAL, FT.WINDOW_STATS, ["severity", "seed"], "sampled")
    late = R.packed_orders(delayed_order(spark, sf), READ_TEMPORAL, FT.WINDOW_STATS, ["severity"], "late")
    whole = runs.join(noise, "pair_id", "left").join(sampled, "run_id", "left").join(late, "run_id", "left")
    # a model holds thousands of bytes, so it joins last; the number of tasks is that of the rows to come, not of the few runs
    beside = whole.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *MODEL).join(models(spark, sf), MODEL)
    seeds = lambda base: F.transform(F.array(*[F.lit(s) for s in base]), lambda s: (s + 100 * (F.col("campaign_id") % 2)).cast("int"))
    points = F.concat(
        F.array(R.point("clean", F.col("x"))), R.missing_points(READ, seeds(MISSING_SEEDS)), R.noise_points(READ, seeds(NOISE_SEEDS)), R.loss_points(READ, FT.LOST_CHANNELS),
        R.reordered_points(READ, READ_TEMPORAL, "sampled", "temporal_sampling", True), R.reordered_points(READ, READ_TEMPORAL, "late", "delay", False))
    held = [c for c in beside.columns if c not in ("x", "noise_sd", "sampled", "late")]
    return beside.select(*held, F.explode(points).alias("_p")).select(*held, "_p.*")


#: Families that neither draw nor reorder: a small part of the grid's work.
PLAIN = ("clean", "channel_loss")
GRID = P.Grid(MISSING_SEEDS, SAMPLING_SEEDS, NOISE_SEEDS)


def row_counts(spark, sf, large):
    """``pairs.point_counts`` of the pairs ``large``, a row a (run, point) until they are counted."""
    scored = G.point_sets(G.scored_points(point_vectors(spark, sf).join(large, "pair_id", "left_semi"), READ, FT.F2))
    anchor = F.coalesce(F.col("lost").startswith("C8") & ~F.col("method").startswith("D4"), F.lit(False))
    direct = F.coalesce(F.col("lost").startswith("C9") & (F.col("method") != "D4-FULL-F3"), F.lit(False))
    alone = F.when(F.col("family") == "clean", F.col("repetition")).cast("int").alias("repetition")
    return scored.where(~anchor & ~direct).groupBy("campaign_id", "condition_id", alone, "method", *POINT, "predicted_set").agg(F.count(F.lit(1)).alias("n"))


def point_counts(spark, sf, families):
    """How often each method predicts each set for the runs of a condition at the points of ``families``.

    Where only plain families are asked for, and the whole grid is not kept already, only they are judged.
    """
    whole = V.is_kept("robust-counts", spark, sf) or not set(families) <= set(PLAIN)
    grid = GRID if whole else replace(GRID, families=PLAIN)

    def build():
        requests = V.sampled_requests(spark, sf)
        large = pin(P.large_pairs(requests))
        n = large.count()
        known = {r["condition_id"]: (r["degree"], r["truth_set"], [r[c] for c in G.LABELS]) for r in G.labels(spark).collect()}
        rows = P.pair_requests(requests)
        if not n:
            return P.point_counts(rows, known, READ, grid)
        large = sized_broadcast(large, n)
        counts = P.point_counts(rows.join(large, "pair_id", "left_anti"), known, READ, grid)
        return counts.unionByName(row_counts(spark, sf, large).where(F.col("family").isin(*grid.families)))

    return V.keep("robust-counts" if whole else "robust-counts-plain", spark, sf, build).where(F.col("family").isin(*families))


def point_predictions(spark, sf, families=GRID.families):
    """Predictions of every method at the points of ``families``: a row for the ``n`` runs of a condition with the same set."""
    rows = point_counts(spark, sf, families).join(F.broadcast(G.labels(spark)), "condition_id")
    has = {f"pred_{c}": F.array_contains(F.split("predicted_set", r"\+"), c).cast("int") for c in DS.CAUSES}
    return rows.withColumns(has).select(
        "method", *POINT, "campaign_id", "condition_id", "repetition", F.col("degree").alias("true_degree"), "truth_set", "predicted_set", *[F.col(f"label_{c}").alias(f"true_{c}") for c in DS.CAUSES],
        *[f"pred_{c}" for c in DS.CAUSES], (F.col("truth_set") == F.col("predicted_set")).cast("int").alias("correct"), "n")


def clean_predictions(spark, sf):
    return point_predictions(spark, sf, ("clean",))


def retained(spark, sf, families=tuple(f for f in GRID.families if f != "clean")):
    """Accuracy at the points of ``families`` against the clean one."""
    whole = V.is_kept("robust-retained", spark, sf) or not set(families) <= set(PLAIN)
    degraded = [f for f in (GRID.families if whole else PLAIN) if f != "clean"]

    def build():
        degraded_rows = point_predictions(spark, sf, degraded)
        return R.retention(degraded_rows, clean_predictions(spark, sf), ["campaign_id", "method", *POINT], ["campaign_id", "method"], "n")

    return V.keep("robust-retained" if whole else "robust-retained-plain", spark, sf, build).where(F.col("family").isin(*families))


@query("degrade_missing", "R1", "SELECT run_id, feature, severity, seed, value FROM rmiss", "severity value")
def degrade_missing(spark, sf):
    return missing_rows(spark, sf).select("run_id", "feature", "severity", "seed", "value")


@query("degrade_noise", "R2 P22", "SELECT run_id, feature, severity, seed, value FROM rnoise", "severity value")
def degrade_noise(spark, sf):
    return noise_rows(spark, sf).select("run_id", "feature", "severity", "seed", "value")


@query("degrade_channel", "R3", "SELECT run_id, feature, lost, value FROM rloss", "value")
def degrade_channel(spark, sf):
    return loss_rows(spark, sf).select("run_id", "feature", "lost", "value")


_RET = "severity compound_exact complete_cause_recall jaccard macro_f1 over_attribution under_attribution control_false_alarm_rate clean_exact clean_alarm retention absolute_loss control_false_alarm_change"


@query("robustness_grid", "R6 R7", "SELECT * FROM gret", _RET)
def robustness_grid(spark, sf):
    return retained(spark, sf)


_CURVES = "family IN ('missingness', 'temporal_sampling', 'noise', 'delay')"


@query(
    "robustness_seeds", "A33 R13",
    f"""SELECT campaign_id, method, family, severity, n, mean, sd, min, max, mean - CASE WHEN sd > 0 THEN {t_half('n', 'sd')} ELSE 0 END AS ci_low, mean + CASE WHEN sd > 0 THEN {t_half('n', 'sd')} ELSE 0 END AS ci_high,
      complete_cause_recall, jaccard, macro_f1, control_false_alarm_rate, clean_exact, mean / nullif(clean_exact, 0) AS retention FROM (
      SELECT campaign_id, method, family, severity, count(*) AS n, avg(compound_exact) AS mean, stddev_samp(compound_exact) AS sd, min(compound_exact) AS min, max(compound_exact) AS max,
      avg(complete_cause_recall) AS complete_cause_recall, avg(jaccard) AS jaccard, avg(macro_f1) AS macro_f1, avg(control_false_alarm_rate) AS control_false_alarm_rate, max(clean_exact) AS clean_exact
      FROM gret WHERE family NOT IN ('channel_loss', 'delay') GROUP BY ALL)""",
    "severity mean sd min max ci_low ci_high complete_cause_recall jaccard macro_f1 control_false_alarm_rate clean_exact retention",
)
def robustness_seeds(spark, sf):
    return R.over_seeds(retained(spark, sf).where("family not in ('channel_loss', 'delay')"), ["campaign_id", "method", "family", "severity"])


_AXIS = f"CASE family WHEN 'temporal_sampling' THEN 1 - severity WHEN 'delay' THEN severity / {max(R.DELAY_LEVELS)} ELSE severity END"
_AUC = f"""SELECT campaign_id, method, family, sum((y + coalesce(py, clean)) / 2 * (x - coalesce(px, 0))) / max(x) AS robustness_auc FROM (
  SELECT *, lag(y) OVER w AS py, lag(x) OVER w AS px FROM (SELECT campaign_id, method, family, {_AXIS} AS x, avg(compound_exact) AS y, max(clean_exact) AS clean FROM gret WHERE {_CURVES} GROUP BY ALL)
  WINDOW w AS (PARTITION BY campaign_id, method, family ORDER BY x)) GROUP BY campaign_id, method, family"""


def auc(spark, sf):
    points = retained(spark, sf).where(_CURVES).groupBy(
        "campaign_id", "method", "family", R.severity_axis(F.col("family"), F.col("severity")).alias("axis")).agg(F.avg("compound_exact").alias("y"), F.first("clean_exact").alias("clean"))
    return R.robustness_auc(points, ["campaign_id", "method", "family"])


@query("robustness_auc", "R8", _AUC, "robustness_auc")
def robustness_auc(spark, sf):
    return auc(spark, sf)


@query("auc_difference", "R9 J21", f"""SELECT *, target_auc - source_auc AS target_minus_source_auc FROM (SELECT CAST(floor(campaign_id / 2) AS BIGINT) AS pair_id, method, family,
  max(robustness_auc) FILTER (WHERE campaign_id % 2 = 0) AS source_auc, max(robustness_auc) FILTER (WHERE campaign_id % 2 = 1) AS target_auc FROM ({_AUC}) GROUP BY ALL)""", "source_auc target_auc target_minus_source_auc")
def auc_difference(spark, sf):
    return R.domain_difference(domains(auc(spark, sf)), ["pair_id", "method", "family"])


_SCREEN = """SELECT campaign_id, method, lost, retention, control_false_alarm_change, CASE WHEN retention >= 0.9 AND control_false_alarm_change <= 0.1 THEN 1 ELSE 0 END AS passes_quality_screen FROM gret WHERE family = 'channel_loss'"""


@query("quality_screen", "R10", _SCREEN, "retention control_false_alarm_change")
def quality_screen(spark, sf):
    return R.quality_screen(retained(spark, sf, ("channel_loss",))).select("campaign_id", "method", "lost", "retention", "control_false_alarm_change", "passes_quality_screen")


@query("cause_robustness", "R11", f"""SELECT g.campaign_id, g.method, g.family, g.severity, g.seed, g.lost, g.cause, g.precision, g.recall, g.f1, c.recall AS clean_recall, c.recall - g.recall AS recall_loss
  FROM ({cause_metrics_sql('rpred', f'campaign_id, method, {_POINTS}')}) g JOIN ({cause_metrics_sql('rclean', 'campaign_id, method')}) c USING (campaign_id, method, cause)""", "severity precision recall f1 clean_recall recall_loss")
def cause_robustness(spark, sf):
    """Every point, the clean one included."""
    table = S.cause_metrics(point_predictions(spark, sf), ["campaign_id", "method", *POINT], "n")
    clean = S.cause_metrics(clean_predictions(spark, sf), ["campaign_id", "method"], "n")
    return R.recall_loss(table, clean, [], ["campaign_id", "method"]).select("campaign_id", "method", *POINT, "cause", "precision", "recall", "f1", "clean_recall", "recall_loss")


_CASES = {"clean_exact": ("clean", None), "missing_50": ("missingness", 0.5), "sampling_25": ("temporal_sampling", 0.25), "noise_50": ("noise", 0.5), "delay_5": ("delay", 5.0)}
_case_sql = lambda f, s: f"avg(y) FILTER (WHERE family = '{f}'" + (f" AND severity = {s}" if s is not None else "") + ")"


@query("pair_robustness", "R12", f"""SELECT campaign_id, method, compound_pair, {', '.join(f"{_case_sql(*c)} AS {n}" for n, c in _CASES.items())}, min(y) FILTER (WHERE family = 'channel_loss') AS worst_channel FROM (
    SELECT campaign_id, method, condition_id AS compound_pair, {_POINTS}, avg(correct::DOUBLE) AS y FROM rpred WHERE true_degree = 2 GROUP BY ALL) GROUP BY campaign_id, method, compound_pair""", f"{' '.join(_CASES)} worst_channel")
def pair_robustness(spark, sf):
    """Exact accuracy of each pair of faults in named cases, and under the channel whose loss hurts it most."""
    return R.pair_worst_cases(point_predictions(spark, sf), ["campaign_id", "method"], POINT, _CASES, "n")


# --- control pairing ------------------------------------------------------------------------------

_RATIOS = ["ttft_median", "total_latency_median"]
_ORD = f"""SELECT r.*, o.start + o.pos AS campaign_order FROM runs r JOIN (
  SELECT run_id, row_number() OVER (PARTITION BY campaign_id, repetition ORDER BY u, condition_id) AS pos, coalesce((SELECT count(*) FROM runs b WHERE b.campaign_id = x.campaign_id AND b.repetition < x.repetition), 0) AS start
  FROM (SELECT *, {uniform("'4242'", 'campaign_id', 'repetition', 'condition_id')} AS u FROM runs) x) o USING (run_id)"""


def ordered_runs(spark, sf):
    return DS.campaign_order(V.runs(spark, sf), 4242)


@query("blocked_order", "D1", f"SELECT campaign_id, condition_id, repetition, run_id, CAST(campaign_order AS BIGINT) AS campaign_order FROM ({_ORD})")
def blocked_order(spark, sf):
    return ordered_runs(spark, sf).select(*RUN, "campaign_order")


_NEAR = f"""WITH o AS ({_ORD}), c AS (SELECT * FROM o WHERE condition_id = 'BASELINE' AND failed_requests < 3)
  SELECT o.run_id, CASE WHEN ctl THEN NULL ELSE near.run_id END AS paired_control_run_id, CASE WHEN ctl THEN NULL ELSE o.ttft_median / nullif(near.ttft_median, 0) END AS ttft_median_ratio,
    CASE WHEN ctl THEN NULL ELSE o.total_latency_median / nullif(near.total_latency_median, 0) END AS total_latency_median_ratio
  FROM (SELECT *, condition_id = 'BASELINE' AND failed_requests < 3 AS ctl FROM o) o LEFT JOIN (
    SELECT * FROM (SELECT o.run_id AS me, c.run_id, c.ttft_median, c.total_latency_median, row_number() OVER (PARTITION BY o.run_id ORDER BY abs(c.campaign_order - o.campaign_order), CASE WHEN c.campaign_order > o.campaign_order THEN 1 ELSE 0 END) AS k
      FROM o JOIN c USING (campaign_id)) WHERE k = 1) near ON near.me = o.run_id"""


@query("nearest_control", "J5", _NEAR, "ttft_median_ratio total_latency_median_ratio")
def nearest_control(spark, sf):
    control = (F.col("condition_id") == "BASELINE") & (F.col("failed_requests") < 3)
    return J.nearest_control(ordered_runs(spark, sf), ["campaign_id"], "campaign_order", control, _RATIOS).select(
        "run_id", "paired_control_run_id", "ttft_median_ratio", "total_latency_median_ratio")


@query("block_control", "J6", """SELECT r.run_id, CASE WHEN r.condition_id = 'BASELINE' AND r.failed_requests < 3 THEN NULL ELSE c.run_id END AS paired_control_run_id,
  CASE WHEN r.condition_id = 'BASELINE' AND r.failed_requests < 3 THEN NULL ELSE r.ttft_median / nullif(c.ttft_median, 0) END AS ttft_median_ratio FROM runs r
  LEFT JOIN runs c ON c.campaign_id = r.campaign_id AND c.repetition = r.repetition AND c.condition_id = 'BASELINE' AND c.failed_requests < 3""", "ttft_median_ratio")
def block_control(spark, sf):
    control = (F.col("condition_id") == "BASELINE") & (F.col("failed_requests") < 3)
    return J.block_control(V.runs(spark, sf), ["campaign_id", "repetition"], control, ["ttft_median"]).select("run_id", "paired_control_run_id", "ttft_median_ratio")


@query("family_control", "J7 D2", """SELECT r.run_id, r.condition_id, d.expected_control_id, c.run_id AS paired_control_run_id, r.ttft_median / nullif(c.ttft_median, 0) AS ttft_median_ratio FROM runs r JOIN cond d USING (condition_id)
  LEFT JOIN runs c ON c.campaign_id = r.campaign_id AND c.repetition = r.repetition AND c.condition_id = d.expected_control_id AND c.failed_requests < 3""", "ttft_median_ratio")
def family_control(spark, sf):
    out = J.family_control(V.runs(spark, sf), DS.conditions(spark), ["campaign_id", "repetition"], ["ttft_median"], F.col("failed_requests") < 3)
    return out.select("run_id", "condition_id", "expected_control_id", "paired_control_run_id", "ttft_median_ratio")


_FAM = """SELECT r.campaign_id, d.mechanism_family, r.condition_id, r.repetition, r.requests_deferred_max, r.failed_requests, r.ttft_median / nullif(c.ttft_median, 0) AS ratio, r.server_output_tokens_median / d.target_output_tokens AS realised
  FROM runs r JOIN cond d USING (condition_id) LEFT JOIN runs c ON c.campaign_id = r.campaign_id AND c.repetition = r.repetition AND c.condition_id = d.expected_control_id"""


def family_rows(spark, sf):
    out = J.family_control(V.runs(spark, sf), DS.conditions(spark), ["campaign_id", "repetition"], ["ttft_median"], F.lit(True))
    return out.drop("expected_control_id").join(F.broadcast(DS.conditions(spark).select("condition_id", "mechanism_family", "target_output_tokens")), "condition_id").withColumns({
        "ratio": F.col("ttft_median_ratio"), "realised": F.col("server_output_tokens_median") / F.col("target_output_tokens")})


@query("severity_selection", "A16 P20", f"""SELECT campaign_id, condition_id, count(*) AS runs, min(ratio) AS ratio_min, max(ratio) AS ratio_max, CASE WHEN max(ratio) IS NULL OR max(ratio) < 1.1 THEN 'weak observed effect' WHEN max(ratio) < 1.5 THEN 'moderate observed effect' ELSE 'strong observed effect' END AS note FROM ({_FAM}) GROUP BY ALL""", "ratio_min ratio_max")
def severity_selection(spark, sf):
    out = family_rows(spark, sf).groupBy("campaign_id", "condition_id").agg(F.count(F.lit(1)).alias("runs"), F.min("ratio").alias("ratio_min"), F.max("ratio").alias("ratio_max"))
    return out.withColumn("note", D.ratio_strength(F.col("ratio_max")))


@query("mechanism_reference", "A17 P17 P18 D4", f"""SELECT campaign_id, condition_id, mechanism_family, CASE WHEN bool_or(mechanism_family IN ('input', 'output') AND coalesce(requests_deferred_max, 0) > 0) THEN 0 ELSE 1 END AS clean,
  count(*) FILTER (WHERE failed_requests < 3 AND mechanism_family IN ('input', 'output') AND coalesce(requests_deferred_max, 0) > 0) AS confounded_runs, count(*) FILTER (WHERE failed_requests < 3 AND mechanism_family = 'downstream' AND coalesce(requests_deferred_max, 0) > 0) AS secondary_runs,
  count(*) FILTER (WHERE failed_requests >= 3) AS invalid_runs FROM ({_FAM}) GROUP BY ALL""")
def mechanism_reference(spark, sf):
    fam, queue = F.col("mechanism_family"), F.col("requests_deferred_max")
    state = D.confound_state(F.col("failed_requests") < 3, fam, queue)
    rows = family_rows(spark, sf).withColumns({"state": state, "confounded": D.queue_confounded(fam, queue)})
    is_ = lambda s: F.count_if(F.col("state") == s)
    return rows.groupBy("campaign_id", "condition_id", "mechanism_family").agg(
        F.bool_and(~F.col("confounded")).cast("int").alias("clean"), is_("CONFUNDED").alias("confounded_runs"),
        is_("VALID_WITH_SECONDARY_EFFECT").alias("secondary_runs"), is_("INVALID").alias("invalid_runs"))


@query("reference_level", "D4", f"""SELECT campaign_id, mechanism_family, min_by(condition_id, lvl) FILTER (WHERE ok) AS reference_candidate FROM (SELECT *, d.cidx AS lvl, NOT (f.mechanism_family IN ('input', 'output') AND coalesce(requests_deferred_max, 0) > 0) AND coalesce(realised, 0) >= 0.9 AND coalesce(ratio, 0) > 1.05 AS ok
  FROM ({_FAM}) f JOIN cond d USING (condition_id)) GROUP BY campaign_id, mechanism_family""")
def reference_level(spark, sf):
    rank = {c["condition_id"]: i for i, c in enumerate(DS.CONDITIONS)}
    level = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("condition_id")]
    rows = family_rows(spark, sf).withColumns({
        "queue_confounded": D.queue_confounded(F.col("mechanism_family"), F.col("requests_deferred_max")), "token_realization_floor": F.col("realised"),
        "effect_ratio": F.col("ratio"), "candidate": F.col("condition_id"), "level": level})
    return DS.reference_level(rows, ["campaign_id", "mechanism_family"])


@query("context_gate", "D5", """SELECT run_id, CASE WHEN bool_and(prompt_tokens + 16 + 64 < 340) THEN 1 ELSE 0 END AS context_safe, CASE WHEN bool_and(coalesce(server_output_tokens / output_tokens::DOUBLE >= 0.9, false)) THEN 1 ELSE 0 END AS output_controllable FROM req GROUP BY run_id""")
def context_gate(spark, sf):
    rows = V.requests(spark, sf).withColumn("output_fraction", D.token_realization(F.col("server_output_tokens"), F.col("output_tokens")))
    out = DS.context_gate(rows, ["run_id"], limit=340)
    return out.select("run_id", F.col("context_safe").cast("int").alias("context_safe"), F.col("output_controllable").cast("int").alias("output_controllable"))


_ARR = "CASE cidx % 3 WHEN 0 THEN 'constant_open_loop' WHEN 1 THEN 'burst' ELSE 'batched_arrival' END"


@query(
    "plan_expansion", "S16 D3",
    f"""SELECT campaign_id, condition_id, repetition, run_id, run_id || '-req-' || lpad(CAST(s AS VARCHAR), 6, '0') AS request_id, s AS sequence,
      1e0 + CASE pat WHEN 'constant_open_loop' THEN s * inter_arrival_seconds WHEN 'burst' THEN floor(s / 2) * 1e0 ELSE floor(s / 3) * inter_arrival_seconds END AS scheduled_arrival, prompt_profile,
      prompt_profile || '-' || CAST(s % 8 AS VARCHAR) AS prompt_id, greatest(1, target_output_tokens + CAST(floor({uniform("'4242'", 'run_id', 'CAST(s AS VARCHAR)')} * 5) AS BIGINT) - 2) AS target_output_tokens
    FROM (SELECT {RUN_SQL}, inter_arrival_seconds, prompt_profile, target_output_tokens, {_ARR} AS pat, unnest(generate_series(0, measured_request_count - 1)) AS s FROM runs JOIN cond USING (condition_id))""",
    "scheduled_arrival",
)
def plan_expansion(spark, sf):
    index = {c["condition_id"]: i for i, c in enumerate(DS.CONDITIONS)}
    kind = F.create_map(*[F.lit(x) for c, i in index.items() for x in (c, ("constant_open_loop", "burst", "batched_arrival")[i % 3])])
    loads = V.runs(spark, sf).select(*RUN, F.col("measured_request_count").alias("request_count")).join(F.broadcast(DS.conditions(spark)), "condition_id").withColumns({
        "arrival_pattern": kind[F.col("condition_id")], "start_offset_seconds": F.lit(1.0), "burst_size": F.lit(2), "burst_interval_seconds": F.lit(1.0),
        "concurrency": F.lit(3), "output_jitter_tokens": F.lit(2), "seed": F.lit(4242)})
    return DS.workload_plan(loads)


# --- cost -----------------------------------------------------------------------------------------

TABLES["cruns"] = """SELECT *, optional_bytes / request_rows AS optional_bytes_per_request, total_bytes / request_rows AS total_bytes_per_request, telemetry_rows / request_rows::DOUBLE AS telemetry_rows_per_request FROM (
  SELECT campaign_id, CASE WHEN fl = 1 THEN 'LOAD_MEDIUM' ELSE 'BASELINE' END AS workload, CASE event_id % 4 WHEN 0 THEN 'T0_FULL' WHEN 1 THEN 'T1_NO_HOST' WHEN 2 THEN 'T2_NO_RUNTIME' ELSE 'T3_LIGHT' END AS telemetry_config, repetition,
    count(*) AS request_rows, sum(2e2 + k + CASE WHEN event_id % 4 IN (0, 2) THEN 1.2e2 ELSE 0e0 END + CASE WHEN event_id % 4 IN (0, 1) THEN 5e1 ELSE 0e0 END) AS optional_bytes,
    sum(9e2 + k * 2) AS total_bytes, CAST(sum(3 + CASE WHEN event_id % 4 IN (0, 2) THEN 2 ELSE 0 END) AS BIGINT) AS telemetry_rows,
    quantile_cont(ttft, 0.95) AS ttft_p95, quantile_cont(total_latency, 0.95) AS total_latency_p95,
    count(*) FILTER (WHERE status = 'success') / (max(completion_time) - min(actual_arrival)) AS successful_requests_per_second,
    count(*) FILTER (WHERE status = 'success') AS successful_requests, count(*) FILTER (WHERE status = 'admission_failed') AS admission_failed,
    CASE WHEN count(*) FILTER (WHERE status = 'failed') < 6 THEN 1 ELSE 0 END AS valid FROM lat GROUP BY ALL)"""
COST_BLOCK = ["campaign_id", "workload", "repetition"]


def cost_runs(spark, sf):
    def build():
        e4 = F.col("event_id") % 4
        host, runtime = e4.isin(0, 2), e4.isin(0, 1)
        rows = D.success_latencies(V.requests(spark, sf)).withColumns({
            "workload": F.when(F.col("fl") == 1, "LOAD_MEDIUM").otherwise("BASELINE"),
            "telemetry_config": F.element_at(F.array(*[F.lit(c) for c in K.CONFIGS]), (e4 + 1).cast("int")),
            "_opt": F.lit(200.0) + F.col("k") + F.when(host, 120.0).otherwise(0.0) + F.when(runtime, 50.0).otherwise(0.0),
            "_tot": F.lit(900.0) + F.col("k") * 2, "_rows": F.lit(3) + F.when(host, 2).otherwise(0),
        })
        ok = F.col("status") == "success"
        out = grouped_stats(rows, [*COST_BLOCK, "telemetry_config"], [
            F.count(F.lit(1)).alias("request_rows"), F.sum("_opt").alias("optional_bytes"), F.sum("_tot").alias("total_bytes"), F.sum("_rows").alias("telemetry_rows"),
            (F.count_if(ok) / (F.max("success_completion") - F.min("actual_arrival"))).alias("successful_requests_per_second"), F.count_if(ok).alias("successful_requests"),
            F.count_if(F.col("status") == "admission_failed").alias("admission_failed"), (F.count_if(F.col("status") == "failed") < 6).cast("int").alias("valid"),
        ], {"ttft": {"ttft_p95": 0.95}, "total_latency": {"total_latency_p95": 0.95}})
        return out.withColumns({"optional_bytes_per_request": F.col("optional_bytes") / F.col("request_rows"), "total_bytes_per_request": F.col("total_bytes") / F.col("request_rows"),
                                "telemetry_rows_per_request": F.col("telemetry_rows") / F.col("request_rows")})

    return V.keep("cost_runs", spark, sf, build)


_PAIRED = """SELECT c.campaign_id, c.workload, c.repetition, c.telemetry_config || '_vs_T0_FULL' AS comparison, 1 - c.optional_bytes_per_request / f.optional_bytes_per_request AS storage_reduction,
  f.optional_bytes_per_request - c.optional_bytes_per_request AS optional_bytes_saved, c.total_latency_p95 / f.total_latency_p95 - 1 AS relative_total_latency_change, c.ttft_p95 / f.ttft_p95 - 1 AS relative_ttft_change,
  c.successful_requests_per_second / f.successful_requests_per_second - 1 AS relative_throughput_change FROM cruns c JOIN cruns f ON f.campaign_id = c.campaign_id AND f.workload = c.workload AND f.repetition = c.repetition AND f.telemetry_config = 'T0_FULL' WHERE c.telemetry_config <> 'T0_FULL'"""
_PAIR_D = "storage_reduction optional_bytes_saved relative_total_latency_change relative_ttft_change relative_throughput_change"


@query("paired_cost", "T23", _PAIRED, _PAIR_D)
def paired_cost(spark, sf):
    return K.paired_costs(cost_runs(spark, sf), COST_BLOCK)


def _ci(value: str, keys: str, source: str) -> str:
    half = f"CASE WHEN n >= 2 AND sd > 0 THEN {t_half('n', 'sd')} ELSE 0 END"
    return f"SELECT *, mean - {half} AS ci_low, mean + {half} AS ci_high FROM (SELECT {keys}, count({value}) AS n, avg({value}) AS mean, stddev_samp({value}) AS sd, min({value}) AS min, max({value}) AS max FROM {source} GROUP BY {keys})"


_GUARD = f"SELECT *, CASE WHEN ci_high <= 0.05 THEN 1 ELSE 0 END AS passes_guard FROM ({_ci('relative_total_latency_change', 'campaign_id, workload, comparison', f'({_PAIRED})')})"


@query("service_guard", "T24", _GUARD, "mean sd min max ci_low ci_high")
def service_guard(spark, sf):
    return K.service_guard(K.paired_costs(cost_runs(spark, sf), COST_BLOCK), ["campaign_id", "workload"])


_CLONG = "(" + " UNION ALL ".join(f"SELECT campaign_id, workload, telemetry_config, '{c}' AS metric, {c} AS value FROM cruns" for c in K.COST_COLUMNS) + ")"


@query("cost_table", "A28 A27", _ci("value", "campaign_id, workload, telemetry_config, metric", _CLONG), "mean sd min max ci_low ci_high")
def cost_table(spark, sf):
    return K.cost_table(cost_runs(spark, sf), ["campaign_id", "workload", "telemetry_config"])


_FRONT = """SELECT c.campaign_id, c.workload, c.telemetry_config, c.opt, c.lat, q.quality FROM (SELECT campaign_id, workload, telemetry_config, avg(optional_bytes_per_request) AS opt, avg(total_latency_p95) AS lat FROM cruns GROUP BY ALL) c
  JOIN (SELECT campaign_id, config AS telemetry_config, quality FROM (SELECT campaign_id, clean_exact AS quality, unnest(['T0_FULL', 'T2_NO_RUNTIME']) AS config FROM gret WHERE lost = 'C1_HOST_CPU' AND method = 'D4-FULL'
    UNION ALL SELECT campaign_id, compound_exact, unnest(['T1_NO_HOST', 'T3_LIGHT']) FROM gret WHERE lost = 'C1_HOST_CPU' AND method = 'D4-FULL')) q USING (campaign_id, telemetry_config)"""


@query("pareto_frontier", "T25 J14", f"""WITH p AS ({_FRONT}) SELECT *, CASE WHEN EXISTS (SELECT 1 FROM p o WHERE o.campaign_id = p.campaign_id AND o.workload = p.workload AND o.quality >= p.quality AND o.opt <= p.opt AND o.lat <= p.lat
  AND (o.quality > p.quality OR o.opt < p.opt OR o.lat < p.lat)) THEN 1 ELSE 0 END AS pareto_dominated FROM p""", "opt lat quality")
def pareto_frontier(spark, sf):
    costs = cost_runs(spark, sf).groupBy("campaign_id", "workload", "telemetry_config").agg(F.avg("optional_bytes_per_request").alias("opt"), F.avg("total_latency_p95").alias("lat"))
    ref = retained(spark, sf, ("channel_loss",)).where("lost = 'C1_HOST_CPU' and method = 'D4-FULL'")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("telemetry_config"), F.col("compound_exact" if c in ("T1_NO_HOST", "T3_LIGHT") else "clean_exact").alias("quality")) for c in K.CONFIGS]))
    quality = ref.select("campaign_id", rows.alias("r")).select("campaign_id", "r.*")
    return K.pareto(costs.join(quality, ["campaign_id", "telemetry_config"]), ["campaign_id", "workload"], "quality", ("opt", "lat"))


_T1 = "comparison LIKE 'T1_%'"


@query("multi_criteria", "T26", f"""SELECT pair_id, count(*) AS criteria, CASE WHEN min(holds) = 1 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS decision FROM (
  SELECT {_PAIR} AS pair_id, passes_quality_screen AS holds FROM ({_SCREEN}) WHERE lost = 'C1_HOST_CPU' AND method = 'D4-FULL'
  UNION ALL SELECT {_PAIR}, CASE WHEN min(storage_reduction) > 0 THEN 1 ELSE 0 END FROM ({_PAIRED}) WHERE {_T1} GROUP BY 1
  UNION ALL SELECT {_PAIR}, min(passes_guard) FROM ({_GUARD}) WHERE {_T1} GROUP BY 1) GROUP BY pair_id""")
def multi_criteria(spark, sf):
    """Quality on the source, quality on the target, storage and service of each pair of campaigns."""
    pair = F.floor(F.col("campaign_id") / 2).cast("bigint").alias("pair_id")
    paired = K.paired_costs(cost_runs(spark, sf), COST_BLOCK).where("comparison like 'T1_%'")
    screen = quality_screen(spark, sf).where("lost = 'C1_HOST_CPU' and method = 'D4-FULL'").select(pair, F.col("passes_quality_screen").alias("holds"))
    saves = paired.groupBy(pair).agg((F.min("storage_reduction") > 0).cast("int").alias("holds"))
    guard = K.service_guard(paired, ["campaign_id", "workload"]).groupBy(pair).agg(F.min("passes_guard").alias("holds"))
    return K.decision(screen.unionByName(saves).unionByName(guard), ["pair_id"])


@query("integrity_totals", "A30", """SELECT campaign_id, sum(valid)::BIGINT AS valid_runs, (count(*) - sum(valid))::BIGINT AS invalid_runs, sum(request_rows)::BIGINT AS measured_requests, sum(successful_requests)::BIGINT AS successful_measured,
  sum(admission_failed)::BIGINT AS admission_failures, CASE WHEN sum(valid) = 64 AND count(*) = 64 THEN 1 ELSE 0 END AS eligible FROM cruns GROUP BY campaign_id""")
def integrity_totals(spark, sf):
    return K.integrity_totals(cost_runs(spark, sf), ["campaign_id"], 64)


TABLES["late"] = """SELECT run_id, request_id, actual_arrival + 1e-3 AS gateway_receive_time, actual_arrival + 2e-3 AS dependency_start_time, actual_arrival + 4e-3 AS dependency_end_time, actual_arrival + 5e-3 AS llama_dispatch_time,
  first_token_time AS llama_first_token_time, completion_time AS gateway_completion_time, 2e-3 AS dependency_duration FROM req WHERE event_id % 3 <> 0"""


def late_timings(spark, sf):
    a = F.col("actual_arrival")
    return V.requests(spark, sf).where("event_id % 3 <> 0").select(
        *RUN, "request_id", (a + 1e-3).alias("gateway_receive_time"), (a + 2e-3).alias("dependency_start_time"), (a + 4e-3).alias("dependency_end_time"), (a + 5e-3).alias("llama_dispatch_time"),
        F.col("first_token_time").alias("llama_first_token_time"), F.col("completion_time").alias("gateway_completion_time"), F.lit(2e-3).alias("dependency_duration"))


_NEEDS = " OR ".join(f"r.{f} IS NULL" for f in J.GATEWAY_FIELDS)
_LOK = " AND ".join(f"{f} IS NOT NULL" for f in J.GATEWAY_FIELDS)
_REC = f"""SELECT r.run_id, r.request_id, res AS resolution, CASE WHEN res = 'resolved' THEN l.gateway_receive_time ELSE r.gateway_receive_time END AS gateway_receive_time, CASE WHEN res = 'resolved' THEN l.dependency_duration ELSE r.dependency_duration END AS dependency_duration
  FROM (SELECT r.*, CASE WHEN NOT (status = 'success' AND ({_NEEDS})) THEN 'not_required' WHEN EXISTS (SELECT 1 FROM late l WHERE l.run_id = r.run_id AND l.request_id = r.request_id AND {_LOK}) THEN 'resolved' ELSE 'unresolved' END AS res FROM req r) r
  LEFT JOIN late l ON l.run_id = r.run_id AND l.request_id = r.request_id"""


@query("timing_reconcile", "J19", _REC, "gateway_receive_time dependency_duration")
def timing_reconcile(spark, sf):
    return J.reconcile_timings(V.requests(spark, sf), late_timings(spark, sf), RUN).select("run_id", "request_id", "resolution", "gateway_receive_time", "dependency_duration")


@query("reconcile_report", "J19", f"""SELECT run_id, count(*) FILTER (WHERE resolution <> 'not_required') AS required_count, count(*) FILTER (WHERE resolution = 'resolved') AS resolved_count, count(*) FILTER (WHERE resolution = 'unresolved') AS unresolved_count FROM ({_REC}) GROUP BY run_id""")
def reconcile_report(spark, sf):
    return J.reconciliation_report(J.reconcile_timings(V.requests(spark, sf), late_timings(spark, sf), RUN), ["run_id"])
