"""Queries that hold methods, training protocols, domains and versions of the diagnosis against each other."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.core import mean_of_present, unpivot
from ..operators import campaigns as CM
from ..operators import compare as CP
from ..operators import diagnose as G
from ..operators import features as FT
from ..operators import learners as L
from ..operators import scoring as S
from ..operators import temporal as T
from ..operators.derive import SLO_LIMITS, SLO_MARGINS
from ..operators.design import CAUSES
from ..operators.grouped import grouped_stats
from ..session import pin
from . import tables as V
from .diagnosis_oracle import METRIC_DOUBLES, PRED_COLS, WHO, mean_present, ranked_sql, set_metrics_sql
from .diagnosis_queries import FOLD, by_campaign, features, predictions, vectors
from .oracle import RUN as RUN_SQL
from .oracle import TABLES, t_half, unpivot_sql
from .registry import query
from .robustness_queries import clean_predictions
from .temporal_queries import positioned, series

# --- model grid ------------------------------------------------------------------------------------

#: Training protocols: P1 on runs of at most one cause, P2 on all.
PROTOCOLS = ("P1", "P2")
GRID = [*FOLD, "tier", "protocol"]
GRID_FEATURES = sorted({f for fs in FT.TIERS.values() for f in fs})

_tiers = " UNION ALL ".join(f"SELECT '{t}' AS tier, '{f}' AS feature" for t, fs in FT.TIERS.items() for f in fs)
TABLES["levels"] = "SELECT *, " + ", ".join(f"({m} - {x!r}::DOUBLE) / {x!r}::DOUBLE AS {SLO_MARGINS[m]}" for m, x in SLO_LIMITS.items()) + " FROM runs"
TABLES["tlab"] = f"SELECT * FROM labf UNION ALL BY NAME SELECT * FROM ({unpivot_sql('levels', RUN_SQL, FT.F0)}) JOIN lab USING (condition_id)"
TABLES["tspl"] = f"""SELECT l.*, tier, protocol, fold, CASE WHEN fold = repetition THEN 'test' ELSE 'train' END AS role FROM tlab l JOIN ({_tiers}) USING (feature),
  (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS fold), (SELECT unnest(['P1', 'P2']) AS protocol) WHERE fold = repetition OR degree <= 1 OR protocol = 'P2'"""
for _name in ("fills", "scal", "zz", "cent"):
    _sql = TABLES[_name].replace("campaign_id, fold", "campaign_id, fold, tier, protocol").replace("fold, role, feature", "fold, tier, protocol, role, feature")
    for _other, _new in (("sp2", "tspl"), ("fills", "tfills"), ("scal", "tscal"), ("zz", "tzz"), ("cent", "tcent")):
        _sql = re.sub(rf"\b{_other}\b", _new, _sql)
    TABLES[f"t{_name}"] = _sql
_WHO_T = ", ".join("t." + x.strip() for x in WHO.split(","))
_same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in (*GRID, "feature"))
TABLES["tpred"] = f"""SELECT tier, protocol, method, {PRED_COLS} FROM (
  SELECT *, 'M1' AS method FROM (SELECT *, cell AS predicted_set, row_number() OVER (PARTITION BY run_id, fold, tier, protocol ORDER BY d, cell) AS k FROM (
    SELECT {_WHO_T}, t.fold, t.tier, t.protocol, c.cell, sqrt(sum((t.z - c.c) * (t.z - c.c))) AS d FROM tzz t JOIN tcent c ON {_same('t', 'c')} WHERE t.role = 'test' GROUP BY ALL)) WHERE k = 1
  UNION ALL BY NAME SELECT *, 'M0' AS method FROM (SELECT *, near_set AS predicted_set, row_number() OVER (PARTITION BY run_id, fold, tier, protocol ORDER BY d, near_id) AS k FROM (
    SELECT {_WHO_T}, t.fold, t.tier, t.protocol, c.run_id AS near_id, c.truth_set AS near_set, sqrt(sum((t.z - c.z) * (t.z - c.z))) AS d
    FROM tzz t JOIN tzz c ON {_same('t', 'c')} AND c.role = 'train' WHERE t.role = 'test' GROUP BY ALL)) WHERE k = 1)"""


def grid_rows(long):
    """Every run's features once a tier, protocol and fold that they serve."""
    both = G.split_folds(long.join(F.broadcast(FT.tier_registry(long.sparkSession)), "feature"), "P2").withColumn("protocol", F.explode(F.array(*[F.lit(p) for p in PROTOCOLS])))
    return both.where("role = 'test' or protocol = 'P2' or degree <= 1")


def grid_vectors(long):
    rows = grid_rows(long)
    scale = G.scaling(rows.where("role = 'train'"), GRID)
    return pin(G.vectors(G.standardize(rows, scale, GRID), GRID, GRID_FEATURES))


def _closest_rows(long):
    vecs, width = grid_vectors(long), len(GRID_FEATURES)
    return G.nearest_neighbour(vecs, GRID, width).withColumn("method", F.lit("M0")).unionByName(
        G.nearest_centroid(vecs, GRID, width).withColumns({"method": F.lit("M1"), "neighbour_id": F.lit(None).cast("string")}))


def grid_predictions(spark, sf):
    """M0 and M1 on every tier under both protocols."""

    build = lambda: by_campaign(
        spark, sf, vectors(spark, sf, GRID_FEATURES), lambda v: CM.closest_sets(v, GRID_FEATURES, FT.TIERS, PROTOCOLS), _closest_rows)
    found = V.keep("grid-closest", spark, sf, build)
    return G.finish_predictions(found.withColumns({f"pred_{c}": F.array_contains(F.split("predicted_set", r"\+"), c).cast("int") for c in CAUSES}))


_T_SUBSETS = """(SELECT *, 'ALL' AS subset FROM tpred UNION ALL SELECT *, 'CONTROL' FROM tpred WHERE true_degree = 0 UNION ALL SELECT *, 'SINGLE' FROM tpred WHERE true_degree = 1
  UNION ALL SELECT *, 'COMPOUND' FROM tpred WHERE true_degree = 2)"""


@query("model_grid", "M4 M5 M19", set_metrics_sql(_T_SUBSETS, "campaign_id, protocol, tier, method, subset"), METRIC_DOUBLES)
def model_grid(spark, sf):
    """Nearest neighbour and nearest centroid on every feature tier, trained on single faults or on all."""
    return S.set_metrics(S.by_subset(grid_predictions(spark, sf)), ["campaign_id", "protocol", "tier", "method", "subset"])


def linear_grid(spark, sf):
    """M2 and M3 on every tier under both protocols. A feature that a tier lacks gets no weight."""
    out = None
    for method, loss in (("M2", "logistic"), ("M3", "hinge")):
        build = lambda loss=loss: by_campaign(
            spark, sf, vectors(spark, sf, GRID_FEATURES), lambda v: CM.linear_values(v, GRID_FEATURES, loss, FT.TIERS, PROTOCOLS),
            lambda long: L.fitted_values(grid_vectors(long), GRID, loss))
        preds = L.value_predictions(V.keep(f"grid-linear-{loss}", spark, sf, build), method, loss)
        out = preds if out is None else out.unionByName(preds)
    return out


@query("model_grid_linear", "M6 M7 M19")
def model_grid_linear(spark, sf):
    """The fitted linear methods on every feature tier under both protocols."""
    return S.set_metrics(S.by_subset(linear_grid(spark, sf)), ["campaign_id", "protocol", "tier", "method", "subset"])


# --- paired comparisons ----------------------------------------------------------------------------

def _paired_sql(diffs: str, keys: str, block: str) -> str:
    """Summary and exact test of a table of keys, block and value: all sign patterns of the blocks."""
    return f"""WITH dd AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {block}) AS pos, count(*) OVER (PARTITION BY {keys}) AS cnt FROM ({diffs}) WHERE value IS NOT NULL),
      oo AS (SELECT {keys}, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, median(value) AS median FROM dd GROUP BY ALL),
      ss AS (SELECT {keys}, mask, abs(avg(value * (((mask >> CAST(pos - 1 AS INT)) & 1) * 2 - 1))) AS stat, max(cnt) AS cnt FROM dd, (SELECT unnest(generate_series(0, 255)) AS mask) WHERE mask < (1 << cnt::INT) GROUP BY ALL),
      pp AS (SELECT {keys}, count(*) FILTER (WHERE stat >= abs(mean) - 1e-12) / count(*)::DOUBLE AS signflip_p FROM ss JOIN oo USING ({keys}) GROUP BY {keys})
    SELECT oo.*, mean - CASE WHEN n >= 2 AND sd > 0 THEN {t_half('n', 'sd')} ELSE 0 END AS ci_low, mean + CASE WHEN n >= 2 AND sd > 0 THEN {t_half('n', 'sd')} ELSE 0 END AS ci_high, signflip_p, 'exact' AS test,
      CASE WHEN mean > 0 AND signflip_p < 0.05 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS verdict FROM oo JOIN pp USING ({keys})"""


_PAIRED = "mean sd median ci_low ci_high signflip_p"
_recall = "avg(CASE WHEN " + " AND ".join(f"pred_{c} >= true_{c}" for c in CAUSES) + " THEN 1e0 ELSE 0 END)"


def _mixed(preds):
    """Complete-cause recall on compounds, mixed training less single training, over folds."""
    recall = S.set_metrics(preds.where("true_degree = 2"), ["campaign_id", "method", "tier", "protocol", "fold"])
    side = lambda p: recall.where(F.col("protocol") == p).withColumnRenamed("method", "model")
    return CP.paired_blocks(side("P1"), side("P2"), ["campaign_id", "model", "tier"], "fold", "complete_cause_recall")


@query("mixed_training", "T20", _paired_sql(f"""SELECT campaign_id, method AS model, tier, fold, b.v - a.v AS value FROM
    (SELECT campaign_id, method, tier, fold, {_recall} AS v FROM tpred WHERE protocol = 'P1' AND true_degree = 2 GROUP BY ALL) a JOIN
    (SELECT campaign_id, method, tier, fold, {_recall} AS v FROM tpred WHERE protocol = 'P2' AND true_degree = 2 GROUP BY ALL) b USING (campaign_id, method, tier, fold)""",
    "campaign_id, model, tier", "fold"), _PAIRED)
def mixed_training(spark, sf):
    """Does training on compounds help to name all causes of one? Neighbour and centroid methods."""
    return _mixed(grid_predictions(spark, sf))


@query("mixed_training_linear", "T20")
def mixed_training_linear(spark, sf):
    return _mixed(linear_grid(spark, sf))


@query("transfer_test", "T22", _paired_sql("""SELECT campaign_id, other, repetition, d.v - o.v AS value FROM
    (SELECT campaign_id, repetition, avg(correct::DOUBLE) AS v FROM rclean WHERE campaign_id % 2 = 1 AND true_degree = 2 AND method = 'D4-FULL' GROUP BY ALL) d JOIN
    (SELECT campaign_id, method AS other, repetition, avg(correct::DOUBLE) AS v FROM rclean WHERE campaign_id % 2 = 1 AND true_degree = 2 AND method <> 'D4-FULL' GROUP BY ALL) o USING (campaign_id, repetition)""",
    "campaign_id, other", "repetition"), _PAIRED)
def transfer_test(spark, sf):
    """Trained on the source, judged on the target: the evidence method against the others, over the target's repetitions."""
    on_target = clean_predictions(spark, sf).where("campaign_id % 2 = 1 and true_degree = 2")
    exact = S.set_metrics(on_target, ["campaign_id", "method", "repetition"], "n")
    others = exact.where("method <> 'D4-FULL'").withColumnRenamed("method", "other")
    lead = exact.where("method = 'D4-FULL'").join(others.select("campaign_id", "other").distinct(), "campaign_id")
    return CP.paired_blocks(others, lead, ["campaign_id", "other"], "repetition", "exact_set_accuracy")


# --- window length and correction ------------------------------------------------------------------

_CHAIN = ["el10", "feat", "labf", "spl", "crow", "meta", "dz", "chan", "gsc", "gst", "gno", "evid", "tauq", "marg", "rankd", "prede"]
for _name in _CHAIN:
    _sql = TABLES[_name]
    if _name == "el10":
        _sql = _sql.replace("<= 10", "<= 20").replace("n - 10", "n - 20")
    for _other in _CHAIN:
        _sql = re.sub(rf"\b{_other}\b", f"w{_other}", _sql)
    TABLES[f"w{_name}"] = _sql.replace("mwide", "wmwide")

WINDOWS = (10, 20)


def window_predictions(spark, sf):
    """Evidence refitted on the features of first and last windows of each length; one ordering serves all lengths."""

    def build():
        keys = [*T.RUN, "k"]
        windows = T.window_features(series(spark, sf), T.RUN, WINDOWS)
        wanted = F.col("metric").isin(*FT.TEMPORAL_METRICS) | F.col("stat").isin(*FT.WINDOW_STATS[2:])
        temporal = unpivot(windows, [*keys, "metric"], FT.WINDOW_STATS, "stat").where(wanted).select(*keys, F.concat_ws("_", "metric", "stat").alias("feature"), "value")
        prefill = unpivot(grouped_stats(series(spark, sf), T.RUN, (), {"prefill_proxy": dict(zip(FT.PREFILL, (0.5, 0.95)))}), T.RUN, FT.PREFILL)
        fixed = unpivot(V.runs(spark, sf), T.RUN, FT.F3).unionByName(prefill).withColumn("k", F.explode(F.array(*[F.lit(k) for k in WINDOWS])))
        keyed = [*FOLD, "k"]
        packed = pin(G.train_evidence(pin(G.labelled(fixed.unionByName(temporal))), keyed))
        ranked = G.ranked_sets(G.packed_margins(packed, pin(G.packed_thresholds(packed, keyed)), keyed), keyed)
        return ranked.where("role = 'test'").withColumn("correct", (F.col("truth_set") == F.col("predicted_set")).cast("double"))

    return V.keep("window-predictions", spark, sf, build)


_windowed = lambda t, n: f"SELECT campaign_id, condition_id, method, avg(CASE WHEN truth_set = predicted_set THEN 1e0 ELSE 0 END) AS {n} FROM {t} WHERE degree = 2 GROUP BY ALL"


@query("window_refit", "W6", f"""SELECT *, CASE WHEN exact_10 IS DISTINCT FROM exact_20 THEN 1 ELSE 0 END AS exact_changed FROM (
    {_windowed('prede', 'exact_10')}) JOIN ({_windowed('wprede', 'exact_20')}) USING (campaign_id, condition_id, method)""", "exact_10 exact_20")
def window_refit(spark, sf):
    """Exact accuracy of each compound with windows of ten and of twenty requests."""
    at = lambda k: F.avg(F.when(F.col("k") == k, F.col("correct"))).alias(f"exact_{k}")
    table = window_predictions(spark, sf).where("degree = 2").groupBy("campaign_id", "condition_id", "method").agg(*[at(k) for k in WINDOWS])
    return table.withColumn("exact_changed", (~F.col("exact_10").eqNullSafe(F.col("exact_20"))).cast("int"))


TABLES["oraw"] = f"""SELECT {WHO}, fold, role, cause, label, avg(z) FILTER (WHERE grp = 'S') AS S, avg(z) FILTER (WHERE grp = 'M') AS M, avg(z) FILTER (WHERE grp = 'T') AS T, avg(greatest(0, -z)) FILTER (WHERE grp = 'M') AS X
  FROM dz JOIN preg USING (cause, feature) GROUP BY ALL"""
TABLES["oevid"] = f"""SELECT *, 'D4-S' AS method, coalesce(S, 0) AS E FROM oraw UNION ALL SELECT *, 'D4-SM', {mean_present('S', 'M')} FROM oraw UNION ALL SELECT *, 'D4-SMT', {mean_present('S', 'M', 'T')} FROM oraw
  UNION ALL SELECT *, 'D4-FULL', {mean_present('S', 'M', 'T')} - coalesce(X, 0) FROM oraw"""
TABLES["otauq"] = "SELECT campaign_id, fold, method, cause, 0.95::DOUBLE AS q, quantile_cont(E, 0.95) AS tau FROM oevid WHERE role = 'train' AND label = 0 GROUP BY ALL"
TABLES["omarg"] = "SELECT oevid.*, otauq.q, otauq.tau, E - tau AS margin FROM oevid JOIN otauq USING (campaign_id, fold, method, cause)"
TABLES["orank"] = ranked_sql("omarg").replace("mwide", "omwide")
TABLES["opred"] = f"SELECT method, {PRED_COLS} FROM (SELECT *, cause_set AS predicted_set FROM orank WHERE rank = 1 AND role = 'test')"
AUDITED = ("exact_set_accuracy", "complete_cause_recall", "jaccard", "macro_f1", "over_attribution", "under_attribution", "control_false_alarm_rate")
VERSIONS = ("D4-S", "D4-SM", "D4-SMT", "D4-FULL")


def earlier_predictions(spark, sf):
    """Predictions of the earlier, ungrouped evidence: every variant that the corrected one has without direct evidence."""

    def build():
        raw = G.plain_evidence(G.labelled(features(spark, sf))).drop("method", "E")
        zero = lambda e: F.coalesce(e, F.lit(0.0))
        s, m, t, x = (F.col(c) for c in "SMTX")
        forms = {"D4-S": zero(s), "D4-SM": zero(mean_of_present(s, m)), "D4-SMT": zero(mean_of_present(s, m, t)), "D4-FULL": zero(mean_of_present(s, m, t)) - zero(x)}
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), e.alias("E")) for n, e in forms.items()]))
        ev = raw.withColumn("_v", each).withColumns({"method": F.col("_v.method"), "E": F.col("_v.E")}).drop("_v")
        return G.evidence_predictions(G.ranked_sets(G.with_margins(ev, FOLD), FOLD))

    return V.keep("earlier-predictions", spark, sf, build)


_names = ", ".join(AUDITED)
_version = lambda t, n: (f"SELECT campaign_id, method, metric, {n} FROM (SELECT {_names}, campaign_id, method FROM ({set_metrics_sql(f'(SELECT * FROM {t} WHERE true_degree = 2)', 'campaign_id, method')}))"  # noqa: E731
                         f" UNPIVOT INCLUDE NULLS ({n} FOR metric IN ({_names}))")


@query("correction_audit", "M18", f"SELECT *, after - before AS change FROM ({_version('opred', 'before')}) FULL JOIN ({_version(f'(SELECT * FROM preds WHERE method IN {VERSIONS})', 'after')}) USING (campaign_id, method, metric)", "before after change")
def correction_audit(spark, sf):
    """Every metric of the earlier and of the corrected evidence on compounds, variant by variant."""
    new = predictions(spark, sf).where(F.col("method").isin(*VERSIONS) & (F.col("true_degree") == 2))
    return CP.metric_diff(earlier_predictions(spark, sf).where("true_degree = 2"), new, ["campaign_id", "method"], AUDITED)
