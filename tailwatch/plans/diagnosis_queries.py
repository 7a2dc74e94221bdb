"""Queries of the diagnosis methods and of their quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.core import unpivot
from ..operators import campaigns as CM
from ..operators import diagnose as G
from ..operators import features as FT
from ..operators import scoring as S
from ..operators import temporal as T
from ..operators.design import CAUSES, CONTROLS
from ..operators.grouped import grouped_stats, sized_broadcast
from ..session import pin
from . import tables as V
from .diagnosis_oracle import CAUSE_DOUBLES, METRIC_DOUBLES, PRED_COLS, WHO, cause_metrics_sql, set_metrics_sql
from .inference_queries import residuals
from .oracle import RUN as RUN_SQL
from .registry import query
from .temporal_queries import series

FOLD = ["campaign_id", "fold"]


def features(spark, sf):
    """Every diagnosis feature of every run, long."""

    def build():
        base = unpivot(V.runs(spark, sf), T.RUN, FT.F3)
        windows = unpivot(T.window_features(series(spark, sf), T.RUN, (10,)), [*T.RUN, "metric"], FT.WINDOW_STATS, "stat")
        wanted = (F.col("metric").isin(*FT.TEMPORAL_METRICS)) | F.col("stat").isin(*FT.WINDOW_STATS[2:])
        temporal = windows.where(wanted).select(*T.RUN, F.concat_ws("_", "metric", "stat").alias("feature"), "value")
        prefill = grouped_stats(series(spark, sf), T.RUN, (), {"prefill_proxy": dict(zip(FT.PREFILL, (0.5, 0.95)))})
        return base.unionByName(temporal).unionByName(unpivot(prefill, T.RUN, FT.PREFILL))

    return V.keep("features", spark, sf, build)


def split(spark, sf, tier=None, protocol="P1"):
    long = features(spark, sf)
    if tier:
        long = long.where(F.col("feature").isin(*FT.TIERS[tier]))
    return G.split_folds(G.labelled(long), protocol)


def tier_rows(spark, sf, tier):
    return G.labelled(features(spark, sf).where(F.col("feature").isin(*FT.TIERS[tier])))


def scales(spark, sf, tier="F2", protocol="P1"):
    return V.keep(f"scales-{tier}-{protocol}", spark, sf, lambda: G.fold_scaling(tier_rows(spark, sf, tier), protocol))


def standard(spark, sf, tier="F2", protocol="P1"):
    return G.standard_folds(tier_rows(spark, sf, tier), scales(spark, sf, tier, protocol), protocol)


#: Features that any method reads of a run: those of all tiers and of the evidence.
RUN_FEATURES = sorted({*G.PAIR_FEATURES, *[f for fs in FT.TIERS.values() for f in fs]})


def feature_rows(spark, sf):
    """Labelled runs with the features of every tier, long."""
    return G.labelled(features(spark, sf).unionByName(unpivot(V.runs(spark, sf), T.RUN, FT.F0)))


def vectors(spark, sf, wanted):
    """Every run once, with its ``wanted`` features as an array."""
    whole = V.keep("run-vectors", spark, sf, lambda: G.feature_vectors(feature_rows(spark, sf), ["campaign_id"], RUN_FEATURES))
    return whole.withColumn("x", F.array(*[F.get("x", F.lit(RUN_FEATURES.index(f))) for f in wanted]))


def by_campaign(spark, sf, rows, judge, rows_judge):
    """``judge`` on the run vectors of campaigns that one task holds, ``rows_judge`` on the feature rows of larger ones."""
    large, n = CM.large_campaigns(V.runs(spark, sf))
    if not n:
        return judge(rows)
    large = sized_broadcast(large, n)
    out = judge(rows.join(large, "campaign_id", "left_anti"))
    return out.unionByName(rows_judge(feature_rows(spark, sf).join(large, "campaign_id", "left_semi")).select(out.columns))


def _closest_rows(long):
    long = long.where(F.col("feature").isin(*FT.F2))
    vecs = pin(G.standard_vectors(long, pin(G.fold_scaling(long)), FT.F2))
    near, width = G.nearest_neighbour(vecs, FOLD, len(FT.F2)), len(FT.F2)
    both = near.withColumn("method", F.lit("M0")).unionByName(
        G.nearest_centroid(vecs, FOLD, width).withColumns({"method": F.lit("M1"), "neighbour_id": F.lit(None).cast("string")}))
    return both


def closest(spark, sf, method):
    """Sets of the closest centroid (M1) or the nearest run (M0) of every test run."""
    build = lambda: by_campaign(
        spark, sf, vectors(spark, sf, FT.F2), lambda v: CM.closest_sets(v, FT.F2, {"F2": FT.F2}).drop("tier", "protocol"), _closest_rows)
    return V.keep("closest", spark, sf, build).where(F.col("method") == method)


def packed_evidence(spark, sf):
    return V.keep("evidence", spark, sf, lambda: G.train_evidence(G.labelled(features(spark, sf))))


def evidence(spark, sf):
    return G.unpacked(packed_evidence(spark, sf))


def margins(spark, sf, quantiles=(0.95,)):
    packed = packed_evidence(spark, sf)
    taus = V.keep(f"thresholds-{quantiles}", spark, sf, lambda: G.packed_thresholds(packed, FOLD, quantiles))
    return G.packed_margins(packed, taus, FOLD)


def ranked(spark, sf, quantiles=(0.95,)):
    return G.ranked_sets(margins(spark, sf, quantiles), FOLD)


def _tested_rows(long):
    packed = pin(G.train_evidence(long))
    return G.ranked_sets(G.packed_margins(packed, pin(G.packed_thresholds(packed, FOLD)), FOLD), FOLD).where("role = 'test'")


def tested(spark, sf):
    """``ranked`` of the test runs: their margins come from their campaign's task."""
    build = lambda: by_campaign(
        spark, sf, vectors(spark, sf, G.PAIR_FEATURES), lambda v: CM.evidence_margins(v, G.PAIR_FEATURES), _tested_rows)
    return G.with_ranks(V.keep("tested", spark, sf, build))


def predictions(spark, sf):
    def build():
        parts = [
            G.evidence_predictions(tested(spark, sf)),
            G.predictions_from_key(closest(spark, sf, "M1"), "M1/F2"),
            G.predictions_from_key(closest(spark, sf, "M0"), "M0/F2"),
        ]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    return V.keep("predictions", spark, sf, build)


@query("run_features", "P23 W2 W3 J4", f"SELECT {RUN_SQL}, feature, value FROM feat", "value")
def run_features(spark, sf):
    return features(spark, sf)


@query("labels", "P3 P4 P5 A23", """SELECT campaign_id, condition_id, truth_set, degree, label_INPUT, label_OUTPUT, label_LOAD, label_DOWNSTREAM, count(*) AS run_count FROM runs JOIN lab USING (condition_id) GROUP BY ALL""")
def label_audit(spark, sf):
    labelled = V.runs(spark, sf).select(*T.RUN).join(F.broadcast(G.labels(spark)), "condition_id")
    return labelled.groupBy("campaign_id", "condition_id", "truth_set", "degree", *G.LABELS).agg(F.count(F.lit(1)).alias("run_count"))


@query("leakage_audit", "M28 M32", "SELECT r.tier, f.campaign_id, count(DISTINCT f.feature) AS features, count(DISTINCT f.feature) FILTER (WHERE f.feature IN ("
       + ", ".join(repr(f) for f in FT.FORBIDDEN) + ")) AS issues, count(DISTINCT f.run_id) AS covered_runs FROM feat f JOIN ("
       + " UNION ALL ".join(f"SELECT '{t}' AS tier, '{f}' AS feature" for t, fs in FT.TIERS.items() for f in fs) + ") r USING (feature) GROUP BY r.tier, f.campaign_id")
def leakage_audit(spark, sf):
    """The features that the runs really carry into each tier's fits, and those of them that a fit must not see."""
    carried = features(spark, sf).join(F.broadcast(FT.tier_registry(spark)), "feature")
    forbidden = F.col("feature").isin(*FT.FORBIDDEN)
    names = carried.groupBy("tier", "campaign_id", "feature").agg(F.count(F.lit(1)).alias("n"))
    per_tier = names.groupBy("tier", "campaign_id").agg(F.count(F.lit(1)).alias("features"), F.count_if(forbidden).alias("issues"))
    runs = carried.select("tier", "campaign_id", "run_id").distinct().groupBy("tier", "campaign_id").agg(F.count(F.lit(1)).alias("covered_runs"))
    return per_tier.join(runs, ["tier", "campaign_id"])


@query("fold_split", "M3 P21", "SELECT campaign_id, fold, role, count(DISTINCT run_id) AS runs FROM spl GROUP BY ALL")
def fold_split(spark, sf):
    runs = G.split_folds(G.labelled(V.runs(spark, sf).select(*T.RUN)))
    return runs.groupBy("campaign_id", "fold", "role").agg(F.count(F.lit(1)).alias("runs"))


@query("impute_standardise", "M1", "SELECT run_id, fold, role, feature, z FROM zz", "z")
def impute_standardise(spark, sf):
    return standard(spark, sf).select("run_id", "fold", "role", "feature", "z")


@query(
    "impute_standardise_sample", "M2",
    """SELECT campaign_id, fold, feature, max(fill) AS fill, avg(coalesce(value, fill)) AS mu, CASE WHEN stddev_samp(coalesce(value, fill)) > 1e-12 THEN stddev_samp(coalesce(value, fill)) ELSE 1 END AS sd
    FROM sp2 JOIN fills USING (campaign_id, fold, feature) WHERE role = 'train' GROUP BY campaign_id, fold, feature""", "fill mu sd",
)
def impute_standardise_sample(spark, sf):
    return G.fold_scaling(tier_rows(spark, sf, "F2"), sample=True)


@query("centroid_diagnosis", "M5", "SELECT run_id, fold, truth_set, predicted_set, score FROM predc", "score")
def centroid_diagnosis(spark, sf):
    return closest(spark, sf, "M1").select("run_id", "fold", "truth_set", "predicted_set", "score")


@query("nn_diagnosis", "M4", "SELECT run_id, fold, truth_set, predicted_set, neighbour_id, score FROM predn", "score")
def nn_diagnosis(spark, sf):
    return closest(spark, sf, "M0").select("run_id", "fold", "truth_set", "predicted_set", "neighbour_id", "score")


@query("method_channels", "M30", "SELECT campaign_id, f3, cause, grp, channel, count(*) AS values, count(value) AS present FROM feat JOIN ereg USING (feature) GROUP BY ALL")
def method_channels(spark, sf):
    return features(spark, sf).join(F.broadcast(FT.evidence_registry(spark)), "feature").groupBy("campaign_id", "f3", "cause", "grp", "channel").agg(
        F.count(F.lit(1)).alias("values"), F.count("value").alias("present"))


@query("feature_meta", "M9", "SELECT campaign_id, fold, cause, feature, CAST(dir AS DOUBLE) AS dir, mu0, sigma FROM meta", "dir mu0 sigma")
def feature_meta(spark, sf):
    reg = FT.evidence_registry(spark).select("cause", "feature").distinct()
    return G.fold_meta(G.labelled(features(spark, sf)), FOLD, reg)


_NORM = "S_norm M_norm T_norm X_norm"


@query("evidence_scores", "M10 M11 M12 M13 M14", "SELECT run_id, fold, role, method, cause, label, S, M, T, X, S_norm, M_norm, T_norm, X_norm, E FROM evid", f"S M T X {_NORM} E")
def evidence_scores(spark, sf):
    return evidence(spark, sf).select("run_id", "fold", "role", "method", "cause", "label", "S", "M", "T", "X", *_NORM.split(), "E")


@query("evidence_thresholds", "M15", "SELECT campaign_id, fold, method, cause, tau, count(*) AS rows FROM marg WHERE q = 0.95 GROUP BY ALL", "tau")
def evidence_thresholds(spark, sf):
    m = margins(spark, sf)
    return m.groupBy(*FOLD, "method", "cause", "tau").agg(F.count(F.lit(1)).alias("rows"))


@query("set_ranking", "M16 W8", "SELECT run_id, fold, method, rank, cause_set, score AS set_score, CASE WHEN rank = 1 THEN set_margin END AS set_margin FROM rankd WHERE role = 'test' AND q = 0.95", "set_score set_margin")
def set_ranking(spark, sf):
    top = tested(spark, sf).select("run_id", "fold", "method", "set_margin", F.posexplode("ranked").alias("p", "c"))
    return top.select("run_id", "fold", "method", (F.col("p") + 1).alias("rank"), F.col("c.cause_set").alias("cause_set"), (-F.col("c.neg")).alias("set_score"),
                      F.when(F.col("p") == 0, F.col("set_margin")).alias("set_margin"))


@query(
    "cause_ranks", "W7",
    """SELECT run_id, fold, method, cause, margin, row_number() OVER (PARTITION BY run_id, fold, method ORDER BY margin DESC, CASE cause WHEN 'INPUT' THEN 0 WHEN 'OUTPUT' THEN 1 WHEN 'LOAD' THEN 2 ELSE 3 END) AS rank
    FROM marg WHERE role = 'test' AND q = 0.95""", "margin",
)
def cause_ranks(spark, sf):
    return G.cause_ranks(tested(spark, sf)).select("run_id", "fold", "method", "cause", "margin", "rank")


@query(
    "evidence_raw", "M17",
    f"""SELECT run_id, fold, role, cause, label, S, M, T, X, coalesce((coalesce(S, 0) + coalesce(M, 0) + coalesce(T, 0)) / nullif((CASE WHEN S IS NULL THEN 0 ELSE 1 END) + (CASE WHEN M IS NULL THEN 0 ELSE 1 END) + (CASE WHEN T IS NULL THEN 0 ELSE 1 END), 0), 0) - coalesce(X, 0) AS E
    FROM (SELECT run_id, fold, role, cause, label, avg(z) FILTER (WHERE grp = 'S') AS S, avg(z) FILTER (WHERE grp = 'M') AS M, avg(z) FILTER (WHERE grp = 'T') AS T, avg(greatest(0, -z)) FILTER (WHERE grp = 'M') AS X
      FROM dz JOIN preg USING (cause, feature) GROUP BY ALL)""", "S M T X E",
)
def evidence_raw(spark, sf):
    return G.plain_evidence(G.labelled(features(spark, sf))).select("run_id", "fold", "role", "cause", "label", "S", "M", "T", "X", "E")


@query("predictions", "M31 P5", "SELECT method, run_id, fold, true_degree, truth_set, predicted_set, pred_INPUT + pred_OUTPUT + pred_LOAD + pred_DOWNSTREAM AS predicted_count, correct FROM preds")
def predictions_query(spark, sf):
    return predictions(spark, sf).select("method", "run_id", "fold", "true_degree", "truth_set", "predicted_set", "predicted_count", "correct")


_SUBSETS = """(SELECT *, 'ALL' AS subset FROM preds UNION ALL SELECT *, 'CONTROL' FROM preds WHERE true_degree = 0 UNION ALL SELECT *, 'SINGLE' FROM preds WHERE true_degree = 1
  UNION ALL SELECT *, 'COMPOUND' FROM preds WHERE true_degree = 2)"""


@query("set_metrics", "M19 P21", set_metrics_sql(_SUBSETS, "campaign_id, method, subset"), METRIC_DOUBLES)
def set_metrics(spark, sf):
    return S.set_metrics(S.by_subset(predictions(spark, sf)), ["campaign_id", "method", "subset"])


@query("ablation_folds", "M25", set_metrics_sql("(SELECT * FROM preds WHERE true_degree = 2)", "campaign_id, method, fold"), METRIC_DOUBLES)
def ablation_folds(spark, sf):
    return S.set_metrics(predictions(spark, sf).where("true_degree = 2"), ["campaign_id", "method", "fold"])


@query("cause_metrics", "M20", cause_metrics_sql("preds", "campaign_id, method"), CAUSE_DOUBLES)
def cause_metrics(spark, sf):
    return S.cause_metrics(predictions(spark, sf), ["campaign_id", "method"])


@query(
    "topk_coverage", "M21",
    """SELECT campaign_id, method, avg(CASE WHEN r1 = 1 THEN 1e0 ELSE 0 END) AS top1_true_cause_coverage, avg(CASE WHEN r2 = truth THEN 1e0 ELSE 0 END) AS top2_complete_coverage FROM (
      SELECT campaign_id, method, run_id, sum(label) AS truth, sum(label) FILTER (WHERE k = 1) AS r1, sum(label) FILTER (WHERE k <= 2) AS r2 FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id, fold, method ORDER BY margin DESC, CASE cause WHEN 'INPUT' THEN 0 WHEN 'OUTPUT' THEN 1 WHEN 'LOAD' THEN 2 ELSE 3 END) AS k FROM marg WHERE role = 'test' AND q = 0.95)
      GROUP BY ALL) WHERE truth > 0 GROUP BY campaign_id, method""", "top1_true_cause_coverage top2_complete_coverage",
)
def topk_coverage(spark, sf):
    scored = tested(spark, sf).withColumns({f"{c.lower()}_score": F.coalesce(F.col(f"m_{c}"), F.lit(0.0)) for c in CAUSES})
    return S.topk_coverage(G.evidence_predictions(scored), ["campaign_id", "method"])


@query("error_taxonomy", "M22", "SELECT campaign_id, method, run_id, fold, tag FROM tags")
def error_taxonomy(spark, sf):
    return S.with_error_tags(predictions(spark, sf)).select("campaign_id", "method", "run_id", "fold", F.explode("error_tags").alias("tag"))


@query("confusion_sets", "A24", "SELECT campaign_id, method, truth_set, predicted_set, count(*) AS count FROM preds GROUP BY ALL")
def confusion_sets(spark, sf):
    return S.confusion(predictions(spark, sf), ["campaign_id", "method"])


@query(
    "error_modes", "A26",
    """SELECT p.campaign_id, p.method, p.condition_id, coalesce(t.tag, 'NONE') AS main_error FROM (SELECT DISTINCT campaign_id, method, condition_id FROM preds) p LEFT JOIN (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id, method, condition_id ORDER BY c DESC, tag) AS k FROM (SELECT campaign_id, method, condition_id, tag, count(*) AS c FROM tags GROUP BY ALL)) WHERE k = 1) t
    USING (campaign_id, method, condition_id)""",
)
def error_modes(spark, sf):
    return S.main_error(predictions(spark, sf), ["campaign_id", "method", "condition_id"])


_THRESH_PRED = f"(SELECT method, q, {PRED_COLS} FROM (SELECT *, cause_set AS predicted_set FROM rankd WHERE rank = 1 AND role = 'test' AND degree = 2 AND method = 'D4-FULL'))"


@query("threshold_sensitivity", "M23", set_metrics_sql(_THRESH_PRED, "campaign_id, method, q"), "q " + METRIC_DOUBLES)
def threshold_sensitivity(spark, sf):
    tested = ranked(spark, sf, (0.90, 0.95, 0.975)).where("method = 'D4-FULL' and degree = 2")
    preds = G.finish_predictions(tested.where("role = 'test'").withColumn("protocol", F.col("q")).withColumns(
        {f"pred_{c}": F.array_contains(F.split("predicted_set", r"\+"), c).cast("int") for c in CAUSES}))
    return S.set_metrics(preds.withColumnRenamed("protocol", "q"), ["campaign_id", "method", "q"])


@query(
    "abstention", "M24",
    """WITH cuts AS (SELECT campaign_id, method, fold, quantile_cont(set_margin, [0.25, 0.5, 0.75]) AS t FROM rankd WHERE rank = 1 AND role = 'train' AND q = 0.95 GROUP BY ALL),
      c AS (SELECT campaign_id, method, fold, unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS quantile, unnest(t) AS threshold FROM cuts)
    SELECT c.campaign_id, c.method, c.fold, quantile, threshold, avg(CASE WHEN p.set_margin >= threshold THEN 1e0 ELSE 0 END) AS coverage,
      avg(CASE WHEN p.set_margin >= threshold THEN CASE WHEN truth_set = predicted_set THEN 1e0 ELSE 0 END END) AS exact_accuracy_kept
    FROM prede p JOIN c USING (campaign_id, method, fold) GROUP BY ALL""", "quantile threshold coverage exact_accuracy_kept",
)
def abstention(spark, sf):
    r = ranked(spark, sf)
    return S.abstention(r.where("role = 'train'"), G.evidence_predictions(r), ["campaign_id", "method", "fold"])


@query(
    "evidence_outcomes", "J12",
    """SELECT campaign_id, method, cause, outcome, count(*) AS n, avg(S_norm) AS mean_S_norm, avg(M_norm) AS mean_M_norm, avg(T_norm) AS mean_T_norm, avg(X_norm) AS mean_X_norm, avg(margin) AS mean_margin FROM (
      SELECT m.*, CASE WHEN label = 1 AND hit = 1 THEN 'true_positive' WHEN label = 1 THEN 'false_negative' WHEN hit = 1 THEN 'false_positive' ELSE 'true_negative' END AS outcome
      FROM (SELECT g.*, CASE WHEN list_contains(string_split(p.cause_set, '+'), g.cause) THEN 1 ELSE 0 END AS hit FROM marg g JOIN prede p ON p.run_id = g.run_id AND p.fold = g.fold AND p.method = g.method AND p.q = g.q WHERE g.role = 'test') m)
    GROUP BY campaign_id, method, cause, outcome""", "mean_S_norm mean_M_norm mean_T_norm mean_X_norm mean_margin",
)
def evidence_outcomes(spark, sf):
    tested = margins(spark, sf).where("role = 'test'")
    return S.evidence_outcomes(tested, G.evidence_predictions(ranked(spark, sf)), ["campaign_id"])


def _method(name: str) -> str:
    return f"(SELECT * FROM preds WHERE method = '{name}')"


@query(
    "prediction_diff", "J9",
    f"SELECT n.campaign_id, n.run_id, n.predicted_set AS new_set, o.predicted_set AS old_set FROM {_method('M0/F2')} n LEFT JOIN {_method('M1/F2')} o USING (campaign_id, run_id) WHERE o.predicted_set IS DISTINCT FROM n.predicted_set",
)
def prediction_diff(spark, sf):
    p = predictions(spark, sf)
    return S.prediction_mismatch(p.where("method = 'M1/F2'"), p.where("method = 'M0/F2'"), ["campaign_id", "run_id"])


@query(
    "decision_diff", "J10",
    "SELECT *, CASE WHEN old_decision <> new_decision THEN 1 ELSE 0 END AS decision_changed FROM (" + " UNION ALL ".join(
        f"SELECT n.campaign_id, n.run_id, '{c}' AS cause, o.pred_{c} AS old_decision, n.pred_{c} AS new_decision FROM {_method('D4-FULL')} n JOIN {_method('M1/F2')} o USING (campaign_id, run_id)" for c in CAUSES) + ")",
)
def decision_diff(spark, sf):
    p = predictions(spark, sf)
    return S.decision_diff(p.where("method = 'M1/F2'"), p.where("method = 'D4-FULL'"), ["campaign_id", "run_id"])


@query(
    "csd_error_link", "J11",
    "SELECT t.campaign_id, t.method, t.run_id, t.tag, c.csd FROM tags t LEFT JOIN csds c ON c.campaign_id = t.campaign_id AND c.compound = t.condition_id WHERE t.true_degree = 2", "csd",
)
def csd_error_link(spark, sf):
    from ..operators import csd as C

    wrong = S.with_error_tags(predictions(spark, sf).where("true_degree = 2")).select("campaign_id", "method", "run_id", "condition_id", F.explode("error_tags").alias("tag"))
    csds = C.csd(C.feature_means(residuals(spark, sf))).select("campaign_id", F.col("compound").alias("condition_id"), "csd")
    return wrong.join(csds, ["campaign_id", "condition_id"], "left").drop("condition_id")


@query(
    "confirmatory_tests", "T21 T6",
    """WITH f AS (SELECT campaign_id, method, fold, avg(correct::DOUBLE) AS a FROM preds WHERE true_degree = 2 GROUP BY ALL),
      d AS (SELECT x.campaign_id, y.method AS other, x.fold, x.a - y.a AS value FROM f x JOIN f y USING (campaign_id, fold) WHERE x.method = 'D4-FULL' AND y.method IN ('M1/F2', 'D4-SM')),
      o AS (SELECT campaign_id, other, avg(value) AS mean, count(*) AS n FROM d GROUP BY ALL),
      s AS (SELECT campaign_id, other, mask, abs(avg(value * (((mask >> CAST(fold - 1 AS INT)) & 1) * 2 - 1))) AS stat FROM d, (SELECT unnest(generate_series(0, 255)) AS mask) GROUP BY ALL),
      p AS (SELECT campaign_id, other, mean, n, count(*) FILTER (WHERE stat >= abs(mean) - 1e-12) / 256e0 AS signflip_p FROM s JOIN o USING (campaign_id, other) GROUP BY ALL)
    SELECT * EXCLUDE (r), max(least(1, (3 - r) * signflip_p)) OVER (PARTITION BY campaign_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS holm_p,
      CASE WHEN r = 1 THEN least(1, 2 * signflip_p) ELSE signflip_p END AS shortcut_p, CASE WHEN mean > 0 AND signflip_p < 0.05 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS verdict
    FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY signflip_p, other) AS r FROM p)""", "mean signflip_p holm_p shortcut_p",
)
def confirmatory_tests(spark, sf):
    from pyspark.sql import Window

    from ..operators import inference as I

    acc = predictions(spark, sf).where("true_degree = 2").groupBy("campaign_id", "method", "fold").agg(F.avg(F.col("correct").cast("double")).alias("a"))
    lead = acc.where("method = 'D4-FULL'").select("campaign_id", "fold", F.col("a").alias("lead"))
    other = acc.where(F.col("method").isin("M1/F2", "D4-SM")).withColumnRenamed("method", "other")
    diffs = other.join(lead, ["campaign_id", "fold"]).withColumn("value", F.col("lead") - F.col("a"))
    tested = I.holm(I.signflip_mean(diffs, ["campaign_id", "other"], "fold").drop("method"), ["campaign_id"], "signflip_p", "other")
    first = F.row_number().over(Window.partitionBy("campaign_id").orderBy("signflip_p", "other")) == 1
    return tested.withColumns({
        "shortcut_p": F.when(first, F.least(F.lit(1.0), 2 * F.col("signflip_p"))).otherwise(F.col("signflip_p")),
        "verdict": F.when((F.col("mean") > 0) & (F.col("signflip_p") < 0.05), "SUPPORTED").otherwise("NOT_SUPPORTED"),
    })


def domains(long):
    return long.withColumns({
        "pair_id": F.floor(F.col("campaign_id") / 2).cast("bigint"), "domain": F.when(F.col("campaign_id") % 2 == 0, "source").otherwise("target")})


@query(
    "control_alignment", "M26",
    """WITH d AS (SELECT *, CAST(floor(campaign_id / 2) AS BIGINT) AS pair_id, CASE WHEN campaign_id % 2 = 0 THEN 'source' ELSE 'target' END AS domain FROM feat),
      s AS (SELECT pair_id, feature, avg(value) FILTER (WHERE domain = 'source') AS sm, stddev_samp(value) FILTER (WHERE domain = 'source') AS ss, avg(value) FILTER (WHERE domain = 'target') AS tm,
        stddev_samp(value) FILTER (WHERE domain = 'target') AS ts FROM d WHERE condition_id IN ('BASELINE', 'OUTPUT_CONTROL') GROUP BY ALL)
    SELECT d.run_id, d.feature, d.value, CASE WHEN sm IS NULL OR tm IS NULL THEN value WHEN ss > 1e-12 AND ts > 1e-12 THEN sm + (value - tm) / ts * ss ELSE value - tm + sm END AS aligned
    FROM d LEFT JOIN s USING (pair_id, feature) WHERE domain = 'target'""", "value aligned",
)
def control_alignment(spark, sf):
    return S.control_align(domains(features(spark, sf)), ["pair_id"], CONTROLS).select("run_id", "feature", "value", "aligned")


_DOM_PRED = "(SELECT *, CAST(floor(campaign_id / 2) AS BIGINT) AS pair_id, campaign_id % 2 AS dom FROM preds WHERE true_degree = 2)"


@query(
    "generalisation_drop", "M27",
    f"""SELECT pair_id, method, t.v AS target_value, s.v AS source_value, s.v - t.v AS absolute_drop, t.v / nullif(s.v, 0) AS retention
    FROM (SELECT pair_id, method, avg(correct::DOUBLE) AS v FROM {_DOM_PRED} WHERE dom = 1 GROUP BY ALL) t LEFT JOIN (SELECT pair_id, method, avg(correct::DOUBLE) AS v FROM {_DOM_PRED} WHERE dom = 0 GROUP BY ALL) s USING (pair_id, method)""",
    "target_value source_value absolute_drop retention",
)
def generalisation_drop(spark, sf):
    m = S.set_metrics(domains(predictions(spark, sf).where("true_degree = 2")), ["pair_id", "domain", "method"])
    return S.generalisation_drop(m.where("domain = 'source'"), m.where("domain = 'target'"), ["pair_id", "method"])


@query(
    "pair_transfer", "J13",
    f"""SELECT pair_id, method, condition_id, t.v AS target_value, s.v AS source_value, s.v - t.v AS absolute_drop, t.v / nullif(s.v, 0) AS retention
    FROM (SELECT pair_id, method, condition_id, avg(correct::DOUBLE) AS v FROM {_DOM_PRED} WHERE dom = 1 GROUP BY ALL) t
    LEFT JOIN (SELECT pair_id, method, condition_id, avg(correct::DOUBLE) AS v FROM {_DOM_PRED} WHERE dom = 0 GROUP BY ALL) s USING (pair_id, method, condition_id)""",
    "target_value source_value absolute_drop retention",
)
def pair_transfer(spark, sf):
    m = S.set_metrics(domains(predictions(spark, sf).where("true_degree = 2")), ["pair_id", "domain", "method", "condition_id"])
    return S.generalisation_drop(m.where("domain = 'source'"), m.where("domain = 'target'"), ["pair_id", "method", "condition_id"])


@query("reference_gate", "M29", """SELECT *, CASE WHEN abs(exact_set_accuracy - recorded) <= 1e-9 THEN 1 ELSE 0 END AS matches FROM (
  SELECT campaign_id, avg(correct::DOUBLE) FILTER (WHERE method = 'D4-FULL') AS exact_set_accuracy, avg(correct::DOUBLE) FILTER (WHERE method = 'D4-FULL-F3') AS recorded FROM preds WHERE true_degree = 2 GROUP BY campaign_id)""", "exact_set_accuracy recorded")
def reference_gate(spark, sf):
    """The plain variant's accuracy held against the direct-evidence one."""
    m = S.set_metrics(predictions(spark, sf).where("true_degree = 2"), ["campaign_id", "method"])
    return S.reference_gate(m.where("method = 'D4-FULL'"), m.where("method = 'D4-FULL-F3'"), ["campaign_id"], "exact_set_accuracy")


@query("window_sensitivity", "W6", """SELECT campaign_id, metric, count(*) AS runs, avg(e10) AS early_10, avg(e20) AS early_20, count(*) FILTER (WHERE e10 IS DISTINCT FROM e20) AS changed FROM (
  SELECT campaign_id, run_id, metric, median(value) FILTER (WHERE rn <= 10) AS e10, median(value) FILTER (WHERE rn <= 20) AS e20 FROM serlong GROUP BY ALL) GROUP BY campaign_id, metric""", "early_10 early_20")
def window_sensitivity(spark, sf):
    """The window length is a column, so both settings are one plan."""
    e = T.window_features(series(spark, sf), T.RUN, (10, 20))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("early_median")))
    both = e.groupBy(*T.RUN, "metric").agg(at(10).alias("e10"), at(20).alias("e20"))
    return both.groupBy("campaign_id", "metric").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("e10").alias("early_10"), F.avg("e20").alias("early_20"), F.count_if(~F.col("e10").eqNullSafe(F.col("e20"))).alias("changed"))
