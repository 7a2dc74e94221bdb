"""Queries over run-level tables: summaries, effects, limits, divergence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import portable_uniform, unpivot
from ..operators import csd as C
from ..operators import derive as D
from ..operators import inference as I
from ..operators import runs as R
from . import tables as V
from .oracle import T95, T975, r6, t7_p, t_half, uniform, values  # noqa: F401
from .registry import query

CELL = ["campaign_id", "condition_id", "repetition"]
_Z = 1.959963984540054


def long_features(spark, sf, features=None):
    return unpivot(V.runs(spark, sf), CELL, list(features or C.PRIMARY_FEATURES))


_COUNTS = ["ttft_violations", "total_latency_violations", "decode_duration_violations", "no_slo_runs", "single_slo_runs", "compound_slo_runs"]
_FREQ = " UNION ALL ".join(
    f"SELECT campaign_id, condition_id, n, '{c}' AS count_name, CAST({c} AS BIGINT) AS count FROM freq" for c in _COUNTS)


@query(
    "slo_frequency_wilson", "A12 T7 A34",
    f"""WITH freq AS (SELECT campaign_id, condition_id, count(*) AS n, sum(ttft_slo_violated) AS ttft_violations, sum(total_latency_slo_violated) AS total_latency_violations,
      sum(decode_duration_slo_violated) AS decode_duration_violations, count(*) FILTER (WHERE slo_violation_count = 0) AS no_slo_runs,
      count(*) FILTER (WHERE slo_violation_count = 1) AS single_slo_runs, count(*) FILTER (WHERE slo_violation_count > 1) AS compound_slo_runs FROM runs GROUP BY campaign_id, condition_id)
    SELECT *, count / n::DOUBLE AS proportion,
      greatest(0e0, (count / n::DOUBLE + {_Z ** 2!r} / (2 * n)) / (1 + {_Z ** 2!r}::DOUBLE / n) - {_Z!r}::DOUBLE * sqrt((count / n::DOUBLE) * (1 - count / n::DOUBLE) / n + {_Z ** 2!r}::DOUBLE / (4 * n * n)) / (1 + {_Z ** 2!r}::DOUBLE / n)) AS wilson_low,
      least(1e0, (count / n::DOUBLE + {_Z ** 2!r} / (2 * n)) / (1 + {_Z ** 2!r}::DOUBLE / n) + {_Z!r}::DOUBLE * sqrt((count / n::DOUBLE) * (1 - count / n::DOUBLE) / n + {_Z ** 2!r}::DOUBLE / (4 * n * n)) / (1 + {_Z ** 2!r}::DOUBLE / n)) AS wilson_high
    FROM ({_FREQ})""",
    "proportion wilson_low wilson_high",
)
def slo_frequency_wilson(spark, sf):
    return R.violation_frequency(V.runs(spark, sf))


@query(
    "condition_summary", "A11 A3 T1 P19 P23",
    f"""SELECT campaign_id, condition_id, metric, n, mean, sd, min, max, median, mean - {t_half('n', 'sd')} AS ci_low, mean + {t_half('n', 'sd')} AS ci_high FROM (
      SELECT campaign_id, condition_id, metric, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max, median(value) AS median
      FROM rlong GROUP BY campaign_id, condition_id, metric)""",
    "mean sd min max median ci_low ci_high",
)
def condition_summary(spark, sf):
    return R.condition_summary(V.runs(spark, sf))


@query(
    "direct_evidence", "A13",
    """SELECT campaign_id, condition_id, metric, repetition, value, min, max, median,
      CASE WHEN metric = 'requests_deferred_max' AND condition_id NOT IN ('LOAD_MEDIUM','INPUT_LOAD','OUTPUT_LOAD','LOAD_DOWNSTREAM') AND max > 0 THEN 1 ELSE 0 END AS queue_secondary_signature
    FROM (SELECT r.*, min(value) OVER w AS min, max(value) OVER w AS max, median(value) OVER w AS median
      FROM (SELECT campaign_id, condition_id, metric, repetition, value FROM rlong JOIN evspec USING (condition_id, metric) WHERE value IS NOT NULL) r
      WINDOW w AS (PARTITION BY campaign_id, condition_id, metric))""",
    "value min max median",
)
def direct_evidence(spark, sf):
    return R.direct_evidence(V.runs(spark, sf))


@query(
    "queue_signatures", "A14 P17",
    """SELECT campaign_id, condition_id, max(requests_deferred_max) AS requests_deferred_max_max, max(requests_processing_max) AS requests_processing_max_max, count(*) AS runs,
      median(requests_deferred_max) AS requests_deferred_max_median, median(requests_processing_max) AS requests_processing_max_median,
      CASE WHEN condition_id IN ('LOAD_MEDIUM','INPUT_LOAD','OUTPUT_LOAD','LOAD_DOWNSTREAM') THEN 1 ELSE 0 END AS queueing_intended,
      CASE WHEN condition_id NOT IN ('LOAD_MEDIUM','INPUT_LOAD','OUTPUT_LOAD','LOAD_DOWNSTREAM') AND coalesce(max(requests_deferred_max), 0) > 0 THEN 1 ELSE 0 END AS secondary_observed_queue_signature
    FROM runs GROUP BY campaign_id, condition_id""",
    "requests_deferred_max_max requests_processing_max_max requests_deferred_max_median requests_processing_max_median",
)
def queue_signatures(spark, sf):
    return R.queue_signatures(V.runs(spark, sf))


_STABLE = ["ttft_median", "ttft_p95", "total_latency_median", "total_latency_p95"]


@query(
    "descriptive_stability", "A15",
    f"""SELECT campaign_id, metric, min(value) AS min, max(value) AS max, median(value) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
      stddev_pop(value) / nullif(avg(value), 0) AS cv FROM rlong WHERE condition_id = 'BASELINE' AND metric IN ({', '.join(repr(m) for m in _STABLE)}) GROUP BY campaign_id, metric""",
    "min max median iqr cv",
)
def descriptive_stability(spark, sf):
    healthy = V.runs(spark, sf).where("condition_id = 'BASELINE'")
    return R.descriptive_stability(unpivot(healthy, CELL, _STABLE, "metric"), ["campaign_id", "metric"])


@query(
    "matched_pair_effects", "J2 T1 T2 T3 T4 T5 T13",
    f"""WITH e AS (SELECT campaign_id, mechanism, condition, control, primary_metric, direct_metric, count(delta) AS n, avg(delta) AS mean, stddev_samp(delta) AS sd,
        min(ratio) AS matched_ratio_min, max(ratio) AS matched_ratio_max, median(ratio) AS matched_ratio_median FROM pairs GROUP BY ALL),
      t AS (SELECT *, mean - {t_half('n', 'sd')} AS ci_low, mean + {t_half('n', 'sd')} AS ci_high, CASE WHEN sd > 1e-12 THEN mean / sd END AS dz,
        CASE WHEN sd > 1e-12 THEN mean / (sd / sqrt(n)) END AS t_statistic, CASE WHEN sd > 1e-12 THEN n - 1 END AS df FROM e),
      p AS (SELECT *, {t7_p('t_statistic')} AS raw_p FROM t),
      h AS (SELECT *, least(1, (count(*) OVER (PARTITION BY campaign_id) - row_number() OVER (PARTITION BY campaign_id ORDER BY raw_p, mechanism) + 1) * raw_p) AS step FROM p),
      d AS (SELECT campaign_id, condition_id, metric, median(value) AS med FROM rlong GROUP BY ALL)
    SELECT h.* EXCLUDE (step), max(step) OVER (PARTITION BY h.campaign_id ORDER BY raw_p, mechanism ROWS UNBOUNDED PRECEDING) AS holm_p, d1.med AS direct_evidence_median, d2.med AS control_direct_evidence_median
    FROM h LEFT JOIN d d1 ON d1.campaign_id = h.campaign_id AND d1.condition_id = h.condition AND d1.metric = h.direct_metric
      LEFT JOIN d d2 ON d2.campaign_id = h.campaign_id AND d2.condition_id = h.control AND d2.metric = h.direct_metric""",
    "mean sd matched_ratio_min matched_ratio_max matched_ratio_median ci_low ci_high dz t_statistic raw_p holm_p direct_evidence_median control_direct_evidence_median",
)
def matched_pair_effects(spark, sf):
    return I.isolated_effects(V.runs(spark, sf))


@query(
    "factorial_marginals", "J3 T14",
    """SELECT campaign_id, compound, metric, repetition, a0b0, a1b0, a0b1, a1b1, a1b0 - a0b0 AS effect_a_when_b0, a1b1 - a0b1 AS effect_a_when_b1,
      a0b1 - a0b0 AS effect_b_when_a0, a1b1 - a1b0 AS effect_b_when_a1, a1b1 - a1b0 - a0b1 + a0b0 AS interaction_delta FROM quads
    WHERE metric IN ('ttft_p95', 'total_latency_p95', 'post_first_token_duration_p95')""",
    "a0b0 a1b0 a0b1 a1b1 effect_a_when_b0 effect_a_when_b1 effect_b_when_a0 effect_b_when_a1 interaction_delta",
)
def factorial_marginals(spark, sf):
    return I.factorial_marginals(V.runs(spark, sf))


_INTER_P = f"""SELECT *, concat_ws(':', compound, metric) AS test_id, CASE WHEN t_statistic IS NULL THEN NULL ELSE n - 1 END AS df,
  CASE WHEN t_statistic IS NULL THEN NULL ELSE {t7_p('t_statistic')} END AS raw_p FROM inter"""
_INTER_H = f"""SELECT * EXCLUDE (step), CASE WHEN raw_p IS NOT NULL THEN max(step) OVER (PARTITION BY campaign_id, raw_p IS NULL ORDER BY raw_p, test_id ROWS UNBOUNDED PRECEDING) END AS holm_p FROM (
  SELECT *, least(1, (count(raw_p) OVER (PARTITION BY campaign_id) - row_number() OVER (PARTITION BY campaign_id, raw_p IS NULL ORDER BY raw_p, test_id) + 1) * raw_p) AS step FROM ({_INTER_P}))"""


@query("factorial_interactions", "T15 T16 T5", _INTER_H, "mean sd min max ci_low ci_high dz t_statistic raw_p holm_p")
def factorial_interactions(spark, sf):
    return I.factorial_interactions(V.runs(spark, sf))


_PSEUDO_A, _PSEUDO_B = uniform("'11'", "campaign_id", "compound", "metric"), uniform("'12'", "campaign_id", "compound", "metric")


def _holm_sql(p: str) -> str:
    return f"""SELECT campaign_id, compound, metric, classification, max(least(1, (m - r + 1) * p)) OVER (PARTITION BY campaign_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS holm_p FROM (
      SELECT *, count(*) OVER (PARTITION BY campaign_id) AS m, row_number() OVER (PARTITION BY campaign_id ORDER BY p, test_id) AS r FROM (
        SELECT *, concat_ws(':', compound, metric) AS test_id, pow({p}, 3) AS p FROM inter))"""


@query(
    "significance_audit", "T6 T27 J8",
    f"""SELECT n.campaign_id, n.compound, n.metric, n.holm_p AS new_holm_p, n.classification AS new_class, o.holm_p AS old_holm_p, o.classification AS old_class,
      CASE WHEN (o.holm_p < 0.05) <> (n.holm_p < 0.05) THEN 1 ELSE 0 END AS significance_changed, CASE WHEN o.classification <> n.classification THEN 1 ELSE 0 END AS classification_changed
    FROM ({_holm_sql(_PSEUDO_B)}) n LEFT JOIN ({_holm_sql(_PSEUDO_A)}) o USING (campaign_id, compound, metric)""",
    "new_holm_p old_holm_p",
)
def significance_audit(spark, sf):
    """Two sets of hash-drawn p-values stand for the earlier and the later analysis."""
    tests = I.factorial_interactions(V.runs(spark, sf)).select("campaign_id", "compound", "metric", "test_id", "classification")
    keys = ["campaign_id", "compound", "metric"]

    def drawn(seed):
        p = F.pow(portable_uniform(seed, *[F.col(k) for k in keys]), 3)
        return I.holm(tests.withColumn("p", p), ["campaign_id"], "p", "test_id")

    return I.significance_audit(drawn(11), drawn(12), keys)


_FAM = f"""SELECT *, mean + {T95}[CAST(n - 1 AS INT)] * sd * sqrt(1 + 1e0 / n) AS threshold FROM (
  SELECT campaign_id, s.slo, s.metric, s.condition_id, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd
  FROM rlong JOIN ({values(I.CALIBRATION, 'slo, metric, condition_id')}) s USING (metric, condition_id) GROUP BY campaign_id, s.slo, s.metric, s.condition_id)"""


@query("prediction_limits", "T9", _FAM, "mean sd threshold")
def prediction_limits(spark, sf):
    return I.family_limits(V.runs(spark, sf))


_CAL = f"""SELECT campaign_id, slo, metric, max(threshold) AS final_threshold, first(condition_id ORDER BY threshold DESC, condition_id) AS selected_family,
  min(CASE WHEN n >= 8 THEN 1 ELSE 0 END) AS enough_runs FROM ({_FAM}) GROUP BY campaign_id, slo, metric"""


@query("slo_calibration", "T10", _CAL, "final_threshold")
def slo_calibration(spark, sf):
    return I.slo_calibration(V.runs(spark, sf))


@query(
    "calibration_sanity", "T11 A35",
    f"""WITH c AS ({_CAL}) SELECT r.campaign_id, r.run_id, r.condition_id,
      CASE WHEN r.ttft_p95 > (SELECT final_threshold FROM c WHERE c.campaign_id = r.campaign_id AND slo = 'TTFT_SLO') THEN 1 ELSE 0 END AS ttft_crossed,
      CASE WHEN r.total_latency_p95 > (SELECT final_threshold FROM c WHERE c.campaign_id = r.campaign_id AND slo = 'TOTAL_LATENCY_SLO') THEN 1 ELSE 0 END AS total_latency_crossed,
      CASE WHEN r.condition_id = 'OUTPUT_CONTROL' AND r.post_first_token_duration_p95 > (SELECT final_threshold FROM c WHERE c.campaign_id = r.campaign_id AND slo = 'DECODE_DURATION_SLO') THEN 1 ELSE 0 END AS decode_crossed
    FROM runs r WHERE r.condition_id IN ('BASELINE', 'OUTPUT_CONTROL')""",
)
def calibration_sanity(spark, sf):
    return I.calibration_sanity(V.runs(spark, sf))


@query(
    "precision_plan", "T12",
    f"""SELECT campaign_id, condition_id, metric, candidate_n, abs({T95}[candidate_n - 1] * sd / sqrt(candidate_n) / nullif(mean, 0)) AS relative_half_width FROM (
      SELECT campaign_id, condition_id, metric, avg(value) AS mean, stddev_samp(value) AS sd FROM rlong WHERE condition_id IN ('BASELINE', 'OUTPUT_CONTROL')
      AND metric IN ('ttft_p95', 'total_latency_p95', 'post_first_token_duration_p95') GROUP BY ALL), (SELECT unnest([5, 6, 8, 10]) AS candidate_n)""",
    "relative_half_width",
)
def precision_plan(spark, sf):
    controls = V.runs(spark, sf).where(F.col("condition_id").isin("BASELINE", "OUTPUT_CONTROL"))
    return I.precision_plan(unpivot(controls, CELL, R.COUNTED_METRICS, "metric"), ["campaign_id", "condition_id", "metric"])


def _origins(spark, sf):
    """Even repetitions play the calibration, odd ones the formal campaign; tagged and stacked."""
    runs = V.runs(spark, sf)
    one = runs.where("repetition % 2 = 0").withColumn("origin", F.lit("calibration"))
    two = runs.where("repetition % 2 = 1").withColumn("origin", F.lit("formal"))
    return one.unionByName(two, allowMissingColumns=True)


def _side(o: str) -> str:
    v = f"FILTER (WHERE origin = '{o}')"
    return (f"count(value) {v} AS {o}_n, avg(value) {v} AS {o}_mean, stddev_samp(value) {v} AS {o}_sd, min(value) {v} AS {o}_min, max(value) {v} AS {o}_max")


@query(
    "control_transportability", "A18 T8 J22",
    f"""SELECT *, formal_mean - calibration_mean AS absolute_shift, (formal_mean - calibration_mean) / nullif(calibration_mean, 0) * 100 AS percent_shift,
      (formal_mean - calibration_mean) / sqrt(formal_sd ** 2 / formal_n + calibration_sd ** 2 / calibration_n) AS welch_t,
      (formal_sd ** 2 / formal_n + calibration_sd ** 2 / calibration_n) ** 2 / ((formal_sd ** 2 / formal_n) ** 2 / (formal_n - 1) + (calibration_sd ** 2 / calibration_n) ** 2 / (calibration_n - 1)) AS welch_df
    FROM (SELECT campaign_id, condition_id, metric, {_side('calibration')}, {_side('formal')} FROM (
      SELECT *, CASE WHEN repetition % 2 = 0 THEN 'calibration' ELSE 'formal' END AS origin FROM rlong WHERE condition_id IN ('BASELINE', 'OUTPUT_CONTROL')
      AND metric IN ('ttft_p95', 'total_latency_p95', 'post_first_token_duration_p95')) GROUP BY campaign_id, condition_id, metric)""",
    "calibration_mean calibration_sd calibration_min calibration_max formal_mean formal_sd formal_min formal_max absolute_shift percent_shift welch_t welch_df",
)
def control_transportability(spark, sf):
    """The Welch p-value has fractional degrees of freedom, which the reference SQL cannot express; it is tested apart."""
    return I.control_transportability(_origins(spark, sf), ["campaign_id"]).drop("welch_p")


@query(
    "control_crossings", "A19",
    f"""SELECT campaign_id, CASE WHEN repetition % 2 = 0 THEN 'calibration' ELSE 'formal' END AS origin, condition_id, count(*) AS n,
      CAST(sum(ttft_slo_violated) AS BIGINT) AS ttft_p95_crossings, CAST(sum(total_latency_slo_violated) AS BIGINT) AS total_latency_p95_crossings,
      CAST(sum(decode_duration_slo_violated) AS BIGINT) AS post_first_token_duration_p95_crossings, count(*) FILTER (WHERE slo_violation_count > 0) AS any_counted_slo_crossings
    FROM runs WHERE condition_id IN ('BASELINE', 'OUTPUT_CONTROL') GROUP BY ALL""",
)
def control_crossings(spark, sf):
    return R.control_crossings(_origins(spark, sf), ["campaign_id", "origin", "condition_id"])


def _domains(long):
    """Neighbouring campaigns form a (source, target) pair."""
    return long.withColumns({
        "pair_id": F.floor(F.col("campaign_id") / 2).cast("bigint"),
        "domain": F.when(F.col("campaign_id") % 2 == 0, "source").otherwise("target"),
    })


def _shift_sql(extra: str) -> str:
    s = lambda d: (f"avg(value) FILTER (WHERE domain = '{d}') AS {d}_mean, coalesce(stddev_samp(value) FILTER (WHERE domain = '{d}'), 0) AS {d}_sd, "
                   f"min(value) FILTER (WHERE domain = '{d}') AS {d}_min, max(value) FILTER (WHERE domain = '{d}') AS {d}_max, median(value) FILTER (WHERE domain = '{d}') AS {d}_median")
    return f"""SELECT *, CASE WHEN source_sd > 0 THEN (coalesce(target_mean, 0) - coalesce(source_mean, 0)) / source_sd END AS standardized_mean_shift,
      CASE WHEN source_min IS NOT NULL AND target_min IS NOT NULL THEN CASE WHEN greatest(source_max, target_max) - least(source_min, target_min) > 0
        THEN greatest(0, least(source_max, target_max) - greatest(source_min, target_min)) / (greatest(source_max, target_max) - least(source_min, target_min)) ELSE 1 END END AS range_overlap
    FROM (SELECT CAST(floor(campaign_id / 2) AS BIGINT) AS pair_id, feature{extra}, {s('source')}, {s('target')} FROM (
      SELECT campaign_id, condition_id, metric AS feature, value, CASE WHEN campaign_id % 2 = 0 THEN 'source' ELSE 'target' END AS domain FROM rlong
      WHERE metric IN ({', '.join(repr(f) for f in C.PRIMARY_FEATURES)})) GROUP BY ALL)"""


_SHIFT_D = ("source_mean source_sd source_min source_max source_median target_mean target_sd target_min target_max target_median standardized_mean_shift range_overlap")


@query("feature_shift", "A20", _shift_sql(""), _SHIFT_D)
def feature_shift(spark, sf):
    return I.feature_shift(_domains(long_features(spark, sf, C.PRIMARY_FEATURES)), ["pair_id"])


@query("feature_shift_by_condition", "A21", _shift_sql(", condition_id"), _SHIFT_D)
def feature_shift_by_condition(spark, sf):
    return I.feature_shift(_domains(long_features(spark, sf, C.PRIMARY_FEATURES)), ["pair_id"], by_condition=True)


@query(
    "feature_registry", "A22",
    """SELECT campaign_id, metric AS feature, count(*) AS rows, count(value) AS present, count(*) - count(value) AS missing, count(value) / count(*)::DOUBLE AS availability,
      CASE WHEN count(value) = count(*) THEN 1 ELSE 0 END AS included FROM rlong GROUP BY campaign_id, metric""",
    "availability",
)
def feature_registry(spark, sf):
    return C.registry_missingness(long_features(spark, sf, R.SUMMARY_METRICS))


@query("pooled_scales", "A31 A32", """SELECT campaign_id, compound, feature, s.scale AS sd_scale, m.scale AS mad_scale FROM sdscale s JOIN madscale m USING (campaign_id, compound, feature)
  WHERE feature IN (""" + ", ".join(repr(f) for f in C.PRIMARY_FEATURES) + ")", "sd_scale mad_scale")
def pooled_scales(spark, sf):
    return C.pooled_scales(long_features(spark, sf))


def residuals(spark, sf, kind="sd", extended=False):
    name = f"residuals-{kind}-{extended}"
    features = C.PRIMARY_FEATURES + (C.EXTENDED_FEATURES if extended else [])

    def long():
        if extended:
            return long_features(spark, sf, features)
        return unpivot(V.request_features(spark, sf, features), CELL, features)

    return V.keep(name, spark, sf, lambda: C.residuals(long(), kind))


@query("csd_residuals", "C1 C2", "SELECT campaign_id, compound, feature, repetition, predicted, a1b1, delta, scale, z FROM res", "predicted a1b1 delta scale z")
def csd_residuals(spark, sf):
    return residuals(spark, sf).select(*C.KEYS, "feature", "repetition", "predicted", "a1b1", "delta", "scale", "z")


@query("csd_signature", "C3 C5 C6", """SELECT *, CASE WHEN s > 0 THEN zbar * zbar / s ELSE 0 END AS contribution_fraction,
  CASE WHEN zbar > 1e-9 THEN 'positive' WHEN zbar < -1e-9 THEN 'negative' ELSE 'zero' END AS interaction_direction FROM (SELECT *, sum(zbar * zbar) OVER (PARTITION BY campaign_id, compound) AS s FROM fmeans)""".replace("SELECT *, CASE", "SELECT * EXCLUDE (s), CASE"),
  "control_mean a_only_mean b_only_mean observed_mean predicted_mean raw_residual zbar scale contribution_fraction")
def csd_signature(spark, sf):
    return C.signature(C.feature_means(residuals(spark, sf)))


@query("csd_rep", "C4", "SELECT campaign_id, compound, repetition, sqrt(avg(z * z)) AS csd_r FROM res GROUP BY ALL", "csd_r")
def csd_rep(spark, sf):
    return C.repetition_csd(residuals(spark, sf))


@query("csd_loo", "C7", """SELECT f.campaign_id, f.compound, f.feature, c.csd, sqrt(greatest(0, c.csd * c.csd * c.feature_count - f.zbar * f.zbar) / (c.feature_count - 1)) AS csd_without_feature,
  abs(sqrt(greatest(0, c.csd * c.csd * c.feature_count - f.zbar * f.zbar) / (c.feature_count - 1)) - c.csd) AS absolute_change FROM fmeans f JOIN csds c USING (campaign_id, compound)""",
  "csd csd_without_feature absolute_change")
def csd_loo(spark, sf):
    return C.leave_one_out(C.feature_means(residuals(spark, sf))).select(*C.KEYS, "feature", "csd", "csd_without_feature", "absolute_change")


@query("csd_sensitivity", "C8", """SELECT c.campaign_id, c.compound, c.csd AS primary_csd, m.csd AS robust_csd, e.csd AS extended_csd FROM csds c
  JOIN (SELECT campaign_id, compound, sqrt(avg(zbar * zbar)) AS csd FROM fmeansmad GROUP BY ALL) m USING (campaign_id, compound)
  JOIN (SELECT campaign_id, compound, sqrt(avg(zbar * zbar)) AS csd FROM fmeansext GROUP BY ALL) e USING (campaign_id, compound)""", "primary_csd robust_csd extended_csd")
def csd_sensitivity(spark, sf):
    V.runs(spark, sf)  # the extended view reads it, so the others do as well
    side = lambda name, **kw: C.csd(C.feature_means(residuals(spark, sf, **kw))).select(*C.KEYS, F.col("csd").alias(name))
    return side("primary_csd").join(side("robust_csd", kind="mad"), C.KEYS).join(side("extended_csd", extended=True), C.KEYS)


_FLIP = """SELECT campaign_id, compound, max(csd) AS csd, count(*) FILTER (WHERE stat + 1e-12 >= csd) / 256e0 AS exact_p FROM (
  SELECT campaign_id, compound, mask, sqrt(avg(m * m)) AS stat FROM (
    SELECT campaign_id, compound, feature, mask, avg(z * (((mask >> CAST(repetition - 1 AS INT)) & 1) * 2 - 1)) AS m FROM res, (SELECT unnest(generate_series(0, 255)) AS mask) GROUP BY ALL) GROUP BY ALL)
  JOIN csds USING (campaign_id, compound) GROUP BY campaign_id, compound"""


@query("signflip_vector", "T17 J23", f"SELECT *, 'exact' AS method FROM ({_FLIP})", "csd exact_p")
def signflip_vector(spark, sf):
    return C.signflip_vector(residuals(spark, sf))


_PAIR_FLIP = """SELECT campaign_id, mechanism, any_value(mean) AS mean, any_value(n) AS n, count(*) FILTER (WHERE stat >= abs(mean) - 1e-12) / 256e0 AS signflip_p FROM (
  SELECT campaign_id, mechanism, mask, abs(avg(delta * (((mask >> CAST(repetition - 1 AS INT)) & 1) * 2 - 1))) AS stat FROM pairs, (SELECT unnest(generate_series(0, 255)) AS mask) GROUP BY ALL)
  JOIN (SELECT campaign_id, mechanism, avg(delta) AS mean, count(*) AS n FROM pairs GROUP BY ALL) USING (campaign_id, mechanism) GROUP BY campaign_id, mechanism"""


@query("signflip_mean", "T18", f"SELECT *, 'exact' AS method FROM ({_PAIR_FLIP})", "mean signflip_p")
def signflip_mean(spark, sf):
    return I.signflip_mean(I.matched_pairs(V.runs(spark, sf)), ["campaign_id", "mechanism"], "repetition", "delta")


RESAMPLES = 10_000
_BOOT = f"""SELECT campaign_id, compound, quantile_cont(stat, 0.025) AS bootstrap_low, quantile_cont(stat, 0.975) AS bootstrap_high FROM (
  SELECT campaign_id, compound, b, sqrt(avg(m * m)) AS stat FROM (
    SELECT d.campaign_id, d.compound, d.b, r.feature, avg(r.z) AS m FROM (
      SELECT campaign_id, compound, b, slot, CAST(floor({uniform("'7101'", 'campaign_id', 'compound', 'b', 'slot')} * 8) AS INT) + 1 AS item
      FROM (SELECT DISTINCT campaign_id, compound FROM res), (SELECT unnest(generate_series(1, {RESAMPLES})) AS b), (SELECT unnest(generate_series(1, 8)) AS slot)) d
    JOIN res r ON r.campaign_id = d.campaign_id AND r.compound = d.compound AND r.repetition = d.item GROUP BY ALL) GROUP BY ALL) GROUP BY campaign_id, compound"""


@query("bootstrap_interval", "T19", _BOOT, "bootstrap_low bootstrap_high")
def bootstrap_interval(spark, sf):
    return C.bootstrap_interval(residuals(spark, sf), RESAMPLES)


@query(
    "csd_summary", "C9 J11",
    f"""WITH f AS ({_FLIP}), h AS (SELECT *, max(least(1, (m - r + 1) * exact_p)) OVER (PARTITION BY campaign_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS holm_p FROM (
        SELECT *, count(*) OVER (PARTITION BY campaign_id) AS m, row_number() OVER (PARTITION BY campaign_id ORDER BY exact_p, compound) AS r FROM f)),
      cf AS (SELECT *, zbar * zbar / sum(zbar * zbar) OVER (PARTITION BY campaign_id, compound) AS frac, csd AS c, feature_count AS k FROM fmeans JOIN csds USING (campaign_id, compound)),
      a AS (SELECT campaign_id, compound, max_by(feature, frac) AS largest_contribution_feature, max(frac) AS largest_contribution_fraction, count(*) AS feature_count,
        min(sqrt(greatest(0, c * c * k - zbar * zbar) / (k - 1))) AS loo_csd_min, max(sqrt(greatest(0, c * c * k - zbar * zbar) / (k - 1))) AS loo_csd_max FROM cf GROUP BY campaign_id, compound)
    SELECT h.campaign_id, h.compound, h.csd, h.exact_p, h.holm_p, a.* EXCLUDE (campaign_id, compound), b.bootstrap_low, b.bootstrap_high, m.csd AS robust_scale_csd, e.csd AS extended_csd,
      v.compound_slo_runs, v.runs, CASE WHEN holm_p < 0.05 THEN 1 ELSE 0 END AS statistically_supported
    FROM h JOIN a USING (campaign_id, compound) JOIN ({_BOOT}) b USING (campaign_id, compound)
      LEFT JOIN (SELECT campaign_id, compound, sqrt(avg(zbar * zbar)) AS csd FROM fmeansmad GROUP BY ALL) m USING (campaign_id, compound)
      LEFT JOIN (SELECT campaign_id, compound, sqrt(avg(zbar * zbar)) AS csd FROM fmeansext GROUP BY ALL) e USING (campaign_id, compound)
      LEFT JOIN (SELECT campaign_id, condition_id AS compound, count(*) FILTER (WHERE slo_violation_count > 1) AS compound_slo_runs, count(*) AS runs FROM runs GROUP BY ALL) v USING (campaign_id, compound)""",
    "csd exact_p holm_p largest_contribution_fraction loo_csd_min loo_csd_max bootstrap_low bootstrap_high robust_scale_csd extended_csd",
)
def csd_summary(spark, sf):
    runs = V.runs(spark, sf)
    return C.summary(residuals(spark, sf), residuals(spark, sf, "mad"), residuals(spark, sf, extended=True), runs, RESAMPLES)


@query("csd_sign_gate", "C10", """SELECT f.campaign_id, f.compound, f.feature, f.raw_residual, i.mean AS interaction_mean, CASE WHEN sign(f.raw_residual) = sign(i.mean) THEN 1 ELSE 0 END AS sign_matches
  FROM fmeans f JOIN inter i ON i.campaign_id = f.campaign_id AND i.compound = f.compound AND i.metric = f.feature""", "raw_residual interaction_mean")
def csd_sign_gate(spark, sf):
    runs = V.runs(spark, sf)
    return C.sign_gate(C.feature_means(residuals(spark, sf)), I.factorial_interactions(runs)).select(
        *C.KEYS, "feature", "raw_residual", "interaction_mean", "sign_matches")


@query("result_table", "A36 P19", """SELECT campaign_id, condition_id, sum(ttft_slo_violated) || '/' || count(*) AS ttft_violations, sum(total_latency_slo_violated) || '/' || count(*) AS total_latency_violations,
  sum(decode_duration_slo_violated) || '/' || count(*) AS decode_duration_violations, count(*) FILTER (WHERE slo_violation_count > 1) || '/' || count(*) AS compound_slo_runs FROM runs GROUP BY campaign_id, condition_id""")
def result_table(spark, sf):
    """The interval texts print six significant digits and are tested apart."""
    runs = V.runs(spark, sf)
    return I.result_table(R.condition_summary(runs, R.COUNTED_METRICS), R.violation_frequency(runs)).select(
        "campaign_id", "condition_id", "ttft_violations", "total_latency_violations", "decode_duration_violations", "compound_slo_runs")
