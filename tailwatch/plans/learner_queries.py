"""Queries of the fitted linear methods. Plain SQL has no such fit, so these have no reference SQL; the
fits are tested against their optimality conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import campaigns as CM
from ..operators import diagnose as G
from ..operators import features as FT
from ..operators import learners as L
from ..operators import scoring as S
from ..operators.design import CAUSES
from ..session import pin
from . import tables as V
from .diagnosis_queries import FOLD, by_campaign, vectors
from .registry import query


def _standard(long):
    long = long.where(F.col("feature").isin(*FT.F2))
    return G.standard_vectors(long, pin(G.fold_scaling(long)), FT.F2)


def models(spark, sf, loss):
    rows_fit = lambda long: L.fit(L.cause_targets(_standard(long).where("role = 'train'")), [*FOLD, "cause"], loss)
    return V.keep(f"models-{loss}", spark, sf, lambda: by_campaign(
        spark, sf, vectors(spark, sf, FT.F2), lambda v: CM.linear_models(v, FT.F2, loss), rows_fit))


def values(spark, sf, loss):
    """Value of each cause's fitted function at every test run."""
    return V.keep(f"linear-{loss}", spark, sf, lambda: by_campaign(
        spark, sf, vectors(spark, sf, FT.F2), lambda v: CM.linear_values(v, FT.F2, loss, {"F2": FT.F2}).drop("tier", "protocol"),
        lambda long: L.fitted_values(_standard(long), FOLD, loss)))


@query("logistic_diagnosis", "M6")
def logistic_diagnosis(spark, sf):
    return L.value_predictions(values(spark, sf, "logistic"), "M2/F2", "logistic")


@query("margin_diagnosis", "M7")
def margin_diagnosis(spark, sf):
    return L.value_predictions(values(spark, sf, "hinge"), "M3/F2", "hinge")


@query("descent_comparison", "M8")
def descent_comparison(spark, sf):
    """Scores of the historical fixed-step fit beside those of the converged one."""
    keys = [*FOLD, "run_id"]

    def side(loss, name):
        each = {c: L.decided(F.col(f"f_{c}"), loss) for c in CAUSES}
        packed = F.array(*[F.struct(F.lit(c).alias("cause"), s.alias(f"{name}_score"), d.alias(f"{name}_decision")) for c, (s, d) in each.items()])
        return values(spark, sf, loss).select(*keys, packed.alias(name))

    both = side("logistic", "newton").join(side("descent", "descent"), keys).withColumn("_c", F.explode(F.arrays_zip("newton", "descent")))
    out = both.select(*keys, "_c.newton.*", "_c.descent.descent_score", "_c.descent.descent_decision")
    return out.withColumn("decision_changed", (F.col("newton_decision") != F.col("descent_decision")).cast("int"))


@query("coefficient_stability", "A25")
def coefficient_stability(spark, sf):
    per_fold = models(spark, sf, "logistic").drop("fold")
    return L.coefficient_stability(per_fold, ["campaign_id", "cause"], FT.F2)


@query("logistic_quality", "M6 M19")
def logistic_quality(spark, sf):
    preds = logistic_diagnosis(spark, sf).unionByName(margin_diagnosis(spark, sf))
    return S.set_metrics(S.by_subset(preds), ["campaign_id", "method", "subset"])
