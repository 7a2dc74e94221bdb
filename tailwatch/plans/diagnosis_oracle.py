"""Reference SQL tables of the diagnosis methods."""

from __future__ import annotations

from ..operators import features as FT
from ..operators.design import CAUSES, CAUSE_SETS, CONDITIONS, CAUSE_LABELS
from . import temporal_queries  # noqa: F401  (defines the series tables)
from .oracle import RUN, TABLES, unpivot_sql, values

LAB = ", ".join(f"label_{c}" for c in CAUSES)
WHO = f"{RUN}, degree, truth_set, {LAB}"


def _label_rows():
    out = []
    for c in CONDITIONS:
        has = [x for x in CAUSES if CAUSE_LABELS[x] in c["active_mechanisms"]]
        out.append((c["condition_id"], len(c["active_mechanisms"]), "+".join(has) or "NONE", *[int(x in has) for x in CAUSES]))
    return out


def names(features) -> str:
    return ", ".join(f"'{f}'" for f in features)


TABLES["lab"] = values(_label_rows(), f"condition_id, degree, truth_set, {LAB}")
TABLES["feat"] = (
    unpivot_sql("runs", RUN, FT.F3)
    + " UNION ALL " + " UNION ALL ".join(
        f"SELECT {RUN}, metric || '_{s}' AS feature, {s} AS value FROM el10" + (f" WHERE metric IN ({names(FT.TEMPORAL_METRICS)})" if s in FT.WINDOW_STATS[:2] else "")
        for s in FT.WINDOW_STATS)
    + f" UNION ALL SELECT {RUN}, 'prefill_proxy_median', median(prefill_proxy) FROM ser GROUP BY {RUN}"
    + f" UNION ALL SELECT {RUN}, 'prefill_proxy_p95', quantile_cont(prefill_proxy, 0.95) FROM ser GROUP BY {RUN}"
)
TABLES["labf"] = "SELECT * FROM feat JOIN lab USING (condition_id)"
TABLES["spl"] = ("SELECT *, CASE WHEN fold = repetition THEN 'test' ELSE 'train' END AS role FROM labf, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS fold) "
                 "WHERE fold = repetition OR degree <= 1")
TABLES["sp2"] = f"SELECT * FROM spl WHERE feature IN ({names(FT.F2)})"
TABLES["fills"] = "SELECT campaign_id, fold, feature, median(value) AS fill FROM sp2 WHERE role = 'train' GROUP BY ALL"
TABLES["scal"] = ("SELECT campaign_id, fold, feature, max(fill) AS fill, avg(coalesce(value, fill)) AS mu, "
                  "CASE WHEN stddev_pop(coalesce(value, fill)) > 1e-12 THEN stddev_pop(coalesce(value, fill)) ELSE 1 END AS sd "
                  "FROM sp2 JOIN fills USING (campaign_id, fold, feature) WHERE role = 'train' GROUP BY ALL")
TABLES["zz"] = f"SELECT {WHO}, fold, role, feature, (coalesce(value, fill) - mu) / sd AS z FROM sp2 JOIN scal USING (campaign_id, fold, feature)"
TABLES["cent"] = "SELECT campaign_id, fold, truth_set AS cell, feature, avg(z) AS c FROM zz WHERE role = 'train' GROUP BY ALL"
TABLES["predc"] = f"""SELECT {WHO}, fold, cell AS predicted_set, -d AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, fold ORDER BY d, cell) AS k FROM (
    SELECT {', '.join('t.' + x.strip() for x in WHO.split(','))}, t.fold, c.cell, sqrt(sum((t.z - c.c) * (t.z - c.c))) AS d
    FROM zz t JOIN cent c ON c.campaign_id = t.campaign_id AND c.fold = t.fold AND c.feature = t.feature WHERE t.role = 'test' GROUP BY ALL)) WHERE k = 1"""
TABLES["predn"] = f"""SELECT {WHO}, fold, near_set AS predicted_set, near_id AS neighbour_id, -d AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, fold ORDER BY d, near_id) AS k FROM (
    SELECT {', '.join('t.' + x.strip() for x in WHO.split(','))}, t.fold, c.run_id AS near_id, c.truth_set AS near_set, sqrt(sum((t.z - c.z) * (t.z - c.z))) AS d
    FROM zz t JOIN zz c ON c.campaign_id = t.campaign_id AND c.fold = t.fold AND c.feature = t.feature AND c.role = 'train' WHERE t.role = 'test' GROUP BY ALL)) WHERE k = 1"""

TABLES["ereg"] = values(FT.evidence_rows(), "f3, cause, grp, channel, feature")
TABLES["preg"] = values(FT.plain_group_rows(), "cause, grp, feature")
_cause_label = "CASE cause " + " ".join(f"WHEN '{c}' THEN label_{c}" for c in CAUSES) + " END"
TABLES["crow"] = f"SELECT * FROM (SELECT s.*, cause, {_cause_label} AS label FROM spl s JOIN (SELECT DISTINCT cause, feature FROM ereg) USING (feature))"
TABLES["meta"] = """SELECT campaign_id, fold, cause, feature, CASE WHEN mp > ma THEN 1 ELSE -1 END AS dir, ma AS mu0, greatest(asd, 0.1 * gsd, 1e-12) AS sigma FROM (
  SELECT campaign_id, fold, cause, feature, avg(value) FILTER (WHERE label = 1) AS mp, avg(value) FILTER (WHERE label = 0) AS ma, stddev_samp(value) AS gsd,
  coalesce(stddev_samp(value) FILTER (WHERE label = 0), 0) AS asd FROM crow WHERE role = 'train' GROUP BY ALL) WHERE gsd >= 1e-12 AND abs(mp - ma) >= 0.05 * gsd"""
TABLES["dz"] = f"SELECT {WHO}, fold, role, cause, label, feature, greatest(-5e0, least(5e0, dir * (value - mu0) / sigma)) AS z FROM crow JOIN meta USING (campaign_id, fold, cause, feature) WHERE value IS NOT NULL"
TABLES["chan"] = f"SELECT {WHO}, fold, role, cause, label, f3, grp, channel, avg(z) AS a, avg(greatest(0, z)) AS p, avg(greatest(0, -z)) AS x FROM dz JOIN ereg USING (cause, feature) GROUP BY ALL"
TABLES["gsc"] = f"""SELECT {WHO}, fold, role, cause, label, f3, avg(a) FILTER (WHERE grp = 'S') AS S, avg(a) FILTER (WHERE grp = 'M') AS M, avg(a) FILTER (WHERE grp = 'T') AS T, avg(x) FILTER (WHERE grp = 'M') AS X,
  avg(p) FILTER (WHERE grp = 'S') AS S_pos, avg(p) FILTER (WHERE grp = 'M') AS M_pos, avg(p) FILTER (WHERE grp = 'T') AS T_pos FROM chan GROUP BY ALL"""
_G = ["S", "M", "T", "X", "S_pos", "M_pos", "T_pos"]
TABLES["gst"] = "SELECT campaign_id, fold, cause, f3, " + ", ".join(
    f"avg({g}) FILTER (WHERE label = 0) AS {g}_mu, greatest(coalesce(stddev_samp({g}) FILTER (WHERE label = 0), 0), 0.1 * coalesce(stddev_samp({g}), 0), 1e-12) AS {g}_sg" for g in _G
) + " FROM gsc WHERE role = 'train' GROUP BY ALL"
TABLES["gno"] = "SELECT gsc.*, " + ", ".join(f"({g} - {g}_mu) / {g}_sg AS {g}_norm" for g in _G) + " FROM gsc JOIN gst USING (campaign_id, fold, cause, f3)"


def mean_present(*cols: str) -> str:
    return f"coalesce(({' + '.join(f'coalesce({c}, 0)' for c in cols)}) / nullif({' + '.join(f'(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)' for c in cols)}, 0), 0)"


_full = f"{mean_present('S_norm', 'M_norm', 'T_norm')} - coalesce(X_norm, 0)"
TABLES["evid"] = f"""SELECT *, 'D4-S' AS method, coalesce(S_norm, 0) AS E FROM gno WHERE f3 = 0 UNION ALL SELECT *, 'D4-SM', {mean_present('S_norm', 'M_norm')} FROM gno WHERE f3 = 0
  UNION ALL SELECT *, 'D4-SMT', {mean_present('S_pos_norm', 'M_pos_norm', 'T_pos_norm')} FROM gno WHERE f3 = 0 UNION ALL SELECT *, 'D4-FULL', {_full} FROM gno WHERE f3 = 0
  UNION ALL SELECT *, 'D4-FULL-F3', {_full} FROM gno WHERE f3 = 1"""
TABLES["tauq"] = " UNION ALL ".join(
    f"SELECT campaign_id, fold, method, cause, {q}::DOUBLE AS q, quantile_cont(E, {q}) AS tau FROM evid WHERE role = 'train' AND label = 0 GROUP BY ALL" for q in (0.9, 0.95, 0.975))
TABLES["marg"] = "SELECT evid.*, tauq.q, tauq.tau, E - tau AS margin FROM evid JOIN tauq USING (campaign_id, fold, method, cause)"


def ranked_sql(source: str) -> str:
    wide = f"SELECT {WHO}, fold, role, q, method, " + ", ".join(f"coalesce(max(margin) FILTER (WHERE cause = '{c}'), 0) AS m_{c}" for c in CAUSES) + f" FROM {source} GROUP BY ALL"

    def score(s):
        return " + ".join([f"m_{c}" for c in s] or ["0e0"]) + "".join(f" - greatest(0, m_{c})" for c in CAUSES if c not in s)

    opts = " UNION ALL ".join(f"SELECT *, {score(s)} AS score, {len(s)} AS size, '{'+'.join(s) or 'NONE'}' AS cause_set FROM mwide" for s in CAUSE_SETS)
    return (f"WITH mwide AS ({wide}) SELECT *, score - lead(score) OVER w AS set_margin, row_number() OVER w AS rank FROM ({opts}) "
            "WINDOW w AS (PARTITION BY run_id, fold, q, method ORDER BY score DESC, size, cause_set)")


TABLES["rankd"] = ranked_sql("marg")
TABLES["prede"] = "SELECT *, cause_set AS predicted_set FROM rankd WHERE rank = 1 AND role = 'test' AND q = 0.95"
_p = lambda c: f"CASE WHEN list_contains(string_split(predicted_set, '+'), '{c}') THEN 1 ELSE 0 END AS pred_{c}"
PRED_COLS = (f"{RUN}, fold, degree AS true_degree, truth_set, predicted_set, " + ", ".join(f"label_{c} AS true_{c}" for c in CAUSES) + ", "
             + ", ".join(_p(c) for c in CAUSES) + ", CASE WHEN truth_set = predicted_set THEN 1 ELSE 0 END AS correct")
TABLES["preds"] = (f"SELECT method, {PRED_COLS} FROM prede UNION ALL SELECT 'M1/F2' AS method, {PRED_COLS} FROM predc UNION ALL SELECT 'M0/F2' AS method, {PRED_COLS} FROM predn")


def set_metrics_sql(source: str, keys: str) -> str:
    both = " + ".join(f"true_{c} * pred_{c}" for c in CAUSES)
    either = " + ".join(f"greatest(true_{c}, pred_{c})" for c in CAUSES)
    truth = " + ".join(f"true_{c}" for c in CAUSES)
    extra = " + ".join(f"(1 - true_{c}) * pred_{c}" for c in CAUSES)
    missed = " + ".join(f"true_{c} * (1 - pred_{c})" for c in CAUSES)

    def f1(tp, fp, fn):
        # 2pr/(p+r) with undefined parts as zero equals 2tp/(2tp+fp+fn) with an undefined ratio as zero.
        return f"coalesce(2 * sum({tp}) / nullif(2 * sum({tp}) + sum({fp}) + sum({fn}), 0)::DOUBLE, 0)"

    macro = " + ".join(f1(f"true_{c} * pred_{c}", f"(1 - true_{c}) * pred_{c}", f"true_{c} * (1 - pred_{c})") for c in CAUSES)
    return f"""SELECT {keys}, count(*) AS n, avg(CASE WHEN extra = 0 AND missed = 0 THEN 1e0 ELSE 0 END) AS exact_set_accuracy,
      avg(CASE WHEN either = 0 THEN 1e0 ELSE n_both / either::DOUBLE END) AS jaccard, avg(CASE WHEN truth > 0 THEN CASE WHEN missed = 0 THEN 1e0 ELSE 0 END END) AS complete_cause_recall,
      avg(CASE WHEN truth > 0 THEN n_both / truth::DOUBLE END) AS partial_cause_recall, avg(CASE WHEN extra > 0 THEN 1e0 ELSE 0 END) AS over_attribution,
      avg(CASE WHEN missed > 0 THEN 1e0 ELSE 0 END) AS under_attribution, avg(extra::DOUBLE) AS false_attribution_count, avg(missed::DOUBLE) AS missed_cause_count,
      avg(CASE WHEN truth = 0 THEN CASE WHEN extra > 0 THEN 1e0 ELSE 0 END END) AS control_false_alarm_rate,
      coalesce(sum(n_both) / nullif(sum(n_both) + sum(extra), 0)::DOUBLE, 0) AS micro_precision, coalesce(sum(n_both) / nullif(sum(n_both) + sum(missed), 0)::DOUBLE, 0) AS micro_recall,
      {f1('n_both', 'extra', 'missed')} AS micro_f1, ({macro}) / 4 AS macro_f1, (sum(extra) + sum(missed)) / (count(*) * 4)::DOUBLE AS hamming_loss
    FROM (SELECT *, {both} AS n_both, {either} AS either, {truth} AS truth, {extra} AS extra, {missed} AS missed FROM {source}) GROUP BY {keys}"""


METRIC_DOUBLES = ("exact_set_accuracy jaccard complete_cause_recall partial_cause_recall over_attribution under_attribution false_attribution_count missed_cause_count "
                  "control_false_alarm_rate micro_precision micro_recall micro_f1 macro_f1 hamming_loss")


def cause_metrics_sql(source: str, keys: str) -> str:
    rows = " UNION ALL ".join(f"SELECT {keys}, '{c}' AS cause, true_{c} AS t, pred_{c} AS p FROM {source}" for c in CAUSES)
    return f"""SELECT *, tp + fn AS support, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
      coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0) AS false_positive_rate, coalesce(fn / nullif(fn + tp, 0)::DOUBLE, 0) AS false_negative_rate,
      coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM (
        SELECT {keys}, cause, count(*) FILTER (WHERE t = 1 AND p = 1) AS tp, count(*) FILTER (WHERE t = 0 AND p = 1) AS fp, count(*) FILTER (WHERE t = 1 AND p = 0) AS fn,
        count(*) FILTER (WHERE t = 0 AND p = 0) AS tn FROM ({rows}) GROUP BY {keys}, cause)"""


CAUSE_DOUBLES = "precision recall false_positive_rate false_negative_rate f1"

_miss = " UNION ALL ".join(f"SELECT *, 'MISS_{c}' AS tag FROM preds WHERE true_{c} = 1 AND pred_{c} = 0" for c in CAUSES)
_sum = lambda p: " + ".join(f"{p}_{c}" for c in CAUSES)
TABLES["tags"] = f"""SELECT * FROM ({_miss}
  UNION ALL SELECT *, 'MISS_BOTH' FROM preds WHERE ({_sum('true')}) > 0 AND ({' + '.join(f'true_{c} * (1 - pred_{c})' for c in CAUSES)}) = ({_sum('true')})
  UNION ALL SELECT *, 'EXTRA_CAUSE' FROM preds WHERE ({' + '.join(f'(1 - true_{c}) * pred_{c}' for c in CAUSES)}) > 0
  UNION ALL SELECT *, 'SINGLE_ONLY_PREDICTION' FROM preds WHERE ({_sum('pred')}) = 1
  UNION ALL SELECT *, 'EMPTY_PREDICTION' FROM preds WHERE ({_sum('pred')}) = 0) WHERE correct = 0"""
