"""Quality of predicted cause sets. Every metric is a mean or count of row expressions, so one
grouped aggregate with map-side combining gives them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import harmonic_mean, ratio_or_zero, safe_ratio
from .derive import degree_subsets
from .design import CAUSES


def _total(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def _t(c: str) -> Column:
    return F.col(f"true_{c}")


def _p(c: str) -> Column:
    return F.col(f"pred_{c}")


def _weighted(weight: str | None):
    """Count, mean and sum of an expression over rows, or over what rows stand for where a column counts that."""
    if weight is None:
        return F.count(F.lit(1)), F.avg, F.sum
    w = F.col(weight)
    return F.sum(w), lambda e: F.sum(e * w) / F.sum(F.when(e.isNotNull(), w)), lambda e: F.sum(e * w)


def set_metrics(preds: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Set metrics per group; rates over an empty subset are null, undefined precision is zero. ``weight`` names the column
    that says how many predictions a row stands for."""
    count, mean, total = _weighted(weight)
    both = _total([_t(c) * _p(c) for c in CAUSES])
    either = _total([F.greatest(_t(c), _p(c)) for c in CAUSES])
    truth = _total([_t(c) for c in CAUSES])
    extra = _total([(1 - _t(c)) * _p(c) for c in CAUSES])
    missed = _total([_t(c) * (1 - _p(c)) for c in CAUSES])
    exact = ((extra == 0) & (missed == 0)).cast("double")
    faulty = truth > 0
    aggs = [
        count.alias("n"), mean(exact).alias("exact_set_accuracy"),
        mean(F.when(either == 0, 1.0).otherwise(both / F.nullif(either, F.lit(0)))).alias("jaccard"),
        mean(F.when(faulty, (missed == 0).cast("double"))).alias("complete_cause_recall"),
        mean(F.when(faulty, both / F.nullif(truth, F.lit(0)))).alias("partial_cause_recall"),
        mean((extra > 0).cast("double")).alias("over_attribution"), mean((missed > 0).cast("double")).alias("under_attribution"),
        mean(extra.cast("double")).alias("false_attribution_count"), mean(missed.cast("double")).alias("missed_cause_count"),
        mean(F.when(truth == 0, (extra > 0).cast("double"))).alias("control_false_alarm_rate"),
        total(both).alias("_tp"), total(extra).alias("_fp"), total(missed).alias("_fn"),
    ]
    for c in CAUSES:
        aggs += [total(_t(c) * _p(c)).alias(f"_tp_{c}"), total((1 - _t(c)) * _p(c)).alias(f"_fp_{c}"), total(_t(c) * (1 - _p(c))).alias(f"_fn_{c}")]
    out = preds.groupBy(*keys).agg(*aggs)
    f1 = lambda s: harmonic_mean(ratio_or_zero(F.col(f"_tp{s}"), F.col(f"_tp{s}") + F.col(f"_fp{s}")), ratio_or_zero(F.col(f"_tp{s}"), F.col(f"_tp{s}") + F.col(f"_fn{s}")))
    out = out.withColumns({
        "micro_precision": ratio_or_zero(F.col("_tp"), F.col("_tp") + F.col("_fp")),
        "micro_recall": ratio_or_zero(F.col("_tp"), F.col("_tp") + F.col("_fn")),
        "micro_f1": f1(""), "macro_f1": _total([f1(f"_{c}") for c in CAUSES]) / len(CAUSES),
        "hamming_loss": (F.col("_fp") + F.col("_fn")) / (F.col("n") * len(CAUSES)),
    })
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def by_subset(preds: DataFrame) -> DataFrame:
    """Each prediction once per evaluation subset it belongs to (at most two)."""
    return preds.withColumn("subset", F.explode(degree_subsets(F.col("true_degree"))))


def cause_metrics(preds: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Precision, recall, F1 and error rates per cause; zero when undefined. ``weight`` as in ``set_metrics``."""
    held = F.lit(1) if weight is None else F.col(weight)
    cells = F.array(*[F.struct(F.lit(c).alias("cause"), _t(c).alias("t"), _p(c).alias("p"), held.alias("w")) for c in CAUSES])
    rows = preds.withColumn("_c", F.explode(cells)).select(*keys, "_c.*")
    hit = lambda t, p: F.sum(F.when((F.col("t") == t) & (F.col("p") == p), F.col("w")).otherwise(0))
    out = rows.groupBy(*keys, "cause").agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    c = F.col
    out = out.withColumns({
        "support": c("tp") + c("fn"), "precision": ratio_or_zero(c("tp"), c("tp") + c("fp")), "recall": ratio_or_zero(c("tp"), c("tp") + c("fn")),
        "false_positive_rate": ratio_or_zero(c("fp"), c("fp") + c("tn")), "false_negative_rate": ratio_or_zero(c("fn"), c("fn") + c("tp")),
    })
    return out.withColumn("f1", harmonic_mean(c("precision"), c("recall")))


def topk_coverage(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of faulty runs whose best-scored cause is true, and whose causes are within the best two.

    Ties keep cause order. The four scores are sorted inside the row.
    """
    scored = F.array_sort(F.array(*[
        F.struct((-F.col(f"{c.lower()}_score")).alias("neg"), F.lit(i).alias("i"), _t(c).alias("t")) for i, c in enumerate(CAUSES)]))
    truth = _total([_t(c) for c in CAUSES])
    df = preds.withColumn("_s", scored).where(truth > 0)
    first, second = F.get("_s", F.lit(0))["t"], F.get("_s", F.lit(1))["t"]
    return df.groupBy(*keys).agg(
        F.avg(first.cast("double")).alias("top1_true_cause_coverage"), F.avg((first + second == truth).cast("double")).alias("top2_complete_coverage"))


def with_error_tags(preds: DataFrame) -> DataFrame:
    """Error tags of wrong predictions, as an array; empty for correct ones."""
    missed = {c: (_t(c) == 1) & (_p(c) == 0) for c in CAUSES}
    n_missed = _total([m.cast("int") for m in missed.values()])
    n_pred, truth = _total([_p(c) for c in CAUSES]), _total([_t(c) for c in CAUSES])
    extra = _total([(1 - _t(c)) * _p(c) for c in CAUSES])
    tags = F.array_compact(F.array(
        *[F.when(m, f"MISS_{c}") for c, m in missed.items()],
        F.when((n_missed == truth) & (truth > 0), "MISS_BOTH"), F.when(extra > 0, "EXTRA_CAUSE"),
        F.when(n_pred == 1, "SINGLE_ONLY_PREDICTION"), F.when(n_pred == 0, "EMPTY_PREDICTION"),
    ))
    empty = F.array().cast("array<string>")
    return preds.withColumn("error_tags", F.when(F.col("truth_set") != F.col("predicted_set"), tags).otherwise(empty))


def confusion(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    return preds.groupBy(*keys, "truth_set", "predicted_set").agg(F.count(F.lit(1)).alias("count"))


def main_error(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent error tag per group, ties to the first by name; NONE without errors."""
    tags = with_error_tags(preds).select(*keys, F.explode_outer("error_tags").alias("tag"))
    counts = tags.groupBy(*keys, "tag").agg(F.count("tag").alias("c"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("neg"), F.col("tag"))).alias("b"))
    return best.select(*keys, F.when(F.col("b.neg") < 0, F.col("b.tag")).otherwise("NONE").alias("main_error"))


def prediction_mismatch(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New predictions that are missing in the old set or differ from it."""
    o = old.select(*keys, F.col("predicted_set").alias("old_set"))
    n = new.select(*keys, F.col("predicted_set").alias("new_set"))
    return n.join(o, list(keys), "left").where(~F.col("old_set").eqNullSafe(F.col("new_set")))


def decision_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old and new decision per (run, cause)."""
    def tall(df, name):
        cells = F.array(*[F.struct(F.lit(c).alias("cause"), _p(c).alias(name)) for c in CAUSES])
        return df.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")

    return tall(old, "old_decision").join(tall(new, "new_decision"), [*keys, "cause"]).withColumn(
        "decision_changed", (F.col("old_decision") != F.col("new_decision")).cast("int"))


def outcome(truth: Column, pred: Column) -> Column:
    return (
        F.when((truth == 1) & (pred == 1), "true_positive").when((truth == 1) & (pred == 0), "false_negative")
        .when((truth == 0) & (pred == 1), "false_positive").otherwise("true_negative")
    )


def evidence_outcomes(evidence: DataFrame, preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean evidence components by cause and outcome: a hash join on run and method."""
    own = F.coalesce(*[F.when(F.col("cause") == c, _p(c)) for c in CAUSES])
    joined = evidence.join(preds.select(*keys, "method", "fold", "run_id", *[f"pred_{c}" for c in CAUSES]), [*keys, "method", "fold", "run_id"])
    return joined.withColumn("outcome", outcome(F.col("label"), own)).groupBy(*keys, "method", "cause", "outcome").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"{g}_norm").alias(f"mean_{g}_norm") for g in "SMTX"], F.avg("margin").alias("mean_margin"))


def abstention(train_margins: DataFrame, preds: DataFrame, keys: Sequence[str], quantiles=(0.25, 0.5, 0.75)) -> DataFrame:
    """Coverage and accuracy of predictions whose set margin reaches a training quartile."""
    from .grouped import grouped_stats

    names = {f"_q{i}": q for i, q in enumerate(quantiles)}
    cuts = grouped_stats(train_margins, keys, (), {"set_margin": names})
    rows = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(n).alias("threshold")) for n, q in names.items()]))
    cuts = cuts.select(*keys, rows.alias("t")).select(*keys, "t.*")
    kept = F.col("set_margin") >= F.col("threshold")
    return preds.join(cuts, list(keys)).groupBy(*keys, "quantile", "threshold").agg(
        F.avg(F.coalesce(kept, F.lit(False)).cast("double")).alias("coverage"),
        F.avg(F.when(kept, F.col("correct").cast("double"))).alias("exact_accuracy_kept"))


def generalisation_drop(source: DataFrame, target: DataFrame, keys: Sequence[str], metric: str = "exact_set_accuracy") -> DataFrame:
    s = source.select(*keys, F.col(metric).alias("source_value"))
    t = target.select(*keys, F.col(metric).alias("target_value"))
    return t.join(s, list(keys), "left").withColumns({
        "absolute_drop": F.col("source_value") - F.col("target_value"), "retention": safe_ratio(F.col("target_value"), F.col("source_value"))})


def reference_gate(found: DataFrame, recorded: DataFrame, keys: Sequence[str], metric: str, tolerance: float = 1e-9) -> DataFrame:
    """Recomputed values against recorded ones."""
    r = recorded.select(*keys, F.col(metric).alias("recorded"))
    gap = F.abs(F.col(metric) - F.col("recorded")) <= tolerance
    return found.select(*keys, metric).join(r, list(keys), "left").withColumn("matches", F.coalesce(gap, F.lit(False)).cast("int"))


def control_align(long: DataFrame, keys: Sequence[str], controls: Sequence[str]) -> DataFrame:
    """Map target values onto the source by the controls' mean and SD; location only when an SD is nil."""
    ctl = long.where(F.col("condition_id").isin(*controls))
    v = lambda d: F.when(F.col("domain") == d, F.col("value"))
    stats = ctl.groupBy(*keys, "feature").agg(
        F.avg(v("source")).alias("sm"), F.stddev_samp(v("source")).alias("ss"), F.avg(v("target")).alias("tm"), F.stddev_samp(v("target")).alias("ts"))
    c = F.col
    moved = F.when((c("ss") > 1e-12) & (c("ts") > 1e-12), c("sm") + (c("value") - c("tm")) / c("ts") * c("ss")).otherwise(c("value") - c("tm") + c("sm"))
    out = long.where("domain = 'target'").join(stats, [*keys, "feature"], "left")
    return out.withColumn("aligned", F.when(c("sm").isNull() | c("tm").isNull(), c("value")).otherwise(moved)).drop("sm", "ss", "tm", "ts")
