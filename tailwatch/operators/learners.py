"""Linear one-vs-rest diagnosis: balanced, L2-penalised logistic and squared-hinge margins.

Objective: half the squared weights (intercept included, as a constant feature) plus the weighted
loss, which is the objective of the common liblinear solver at C = 1. Groups of ordinary size are
fitted one per task with Newton steps. Groups above ``HOT_TRAIN_ROWS`` are fitted together by the same
damped steps and stopping test, or the same descent steps, whose loss, gradient and Hessian are summed
per partition and then per group, so training rows are never gathered and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import pin
from .design import CAUSES
from .grouped import hot_groups, sized_broadcast

HOT_TRAIN_ROWS = 200_000
#: Passes over the rows in which damped Newton steps must settle, and steps of the descent.
MOST_PASSES, DESCENT_STEPS = 400, 1600


def _terms(loss: str, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, first and second derivative in the margin y * f."""
    if loss == "logistic":
        p = 1.0 / (1.0 + np.exp(np.clip(margin, -500, 500)))
        return np.logaddexp(0.0, -margin), -p, p * (1 - p)
    gap = np.maximum(0.0, 1.0 - margin)
    return gap**2, -2.0 * gap, 2.0 * (gap > 0)


def _sums(x: np.ndarray, y: np.ndarray, s: np.ndarray, w: np.ndarray, loss: str):
    _, d1, d2 = _terms(loss, y * (x @ w))
    return x.T @ (s * d1 * y), (x * (s * d2)[:, None]).T @ x


def newton_fit(x: np.ndarray, y: np.ndarray, loss: str) -> np.ndarray:
    """Balanced fit of one group; y is -1 or +1, the last weight is the intercept."""
    return damped_newton(x, y, loss)[0]


def damped_newton(x: np.ndarray, y: np.ndarray, loss: str, most_steps: int = 100) -> tuple[np.ndarray, bool]:
    """Weights, and whether the steps became too small to matter within ``most_steps``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    n, pos = len(y), int((y > 0).sum())
    s = np.where(y > 0, n / (2.0 * pos), n / (2.0 * (n - pos)))
    w = np.zeros(x.shape[1])
    value = lambda v: 0.5 * v @ v + float((s * _terms(loss, y * (x @ v))[0]).sum())
    for _ in range(most_steps):
        g, h = _sums(x, y, s, w, loss)
        step = np.linalg.solve(h + np.eye(len(w)), g + w)
        size, now = 1.0, value(w)
        while size > 1e-8 and value(w - size * step) > now:
            size *= 0.5
        w = w - size * step
        if np.abs(size * step).max() < 1e-10:
            return w, True
    return w, False


def descent_fit(x: np.ndarray, y: np.ndarray, steps: int = DESCENT_STEPS, rate: float = 0.05, penalty: float = 1.0) -> np.ndarray:
    """Fixed-step gradient descent on the balanced logistic loss; the intercept is not penalised."""
    t = (y > 0).astype(float)
    n, pos = len(t), t.sum()
    s = np.where(t > 0, n / (2.0 * pos), n / (2.0 * (n - pos)))
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        r = s * (1.0 / (1.0 + np.exp(-np.clip(x @ w + b, -500, 500))) - t)
        w, b = w - rate * (x.T @ r + penalty * w) / n, b - rate * r.sum() / n
    return np.append(w, b)


def cause_targets(vectors: DataFrame) -> DataFrame:
    """One row per cause with the run's vector and that cause's label."""
    cells = F.array(*[F.struct(F.lit(c).alias("cause"), F.col(f"label_{c}").alias("y")) for c in CAUSES])
    return vectors.withColumn("_c", F.explode(cells)).withColumns({"cause": F.col("_c.cause"), "y": F.col("_c.y")}).drop("_c")


def _fit_group(keys: Sequence[str], loss: str):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.where(pdf["y"].to_numpy() == 1, 1.0, -1.0)
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        out = pdf[list(keys)].head(1).copy()
        if (y > 0).all() or (y < 0).all():
            # One class only: a constant answer, far on its side.
            w, settled = np.append(np.zeros(x.shape[1]), 30.0 * y[0]), True
        else:
            w, settled = (descent_fit(x, y), True) if loss == "descent" else damped_newton(x, y, loss)
        out["w"], out["settled"] = [w.tolist()], settled
        return out

    return fit


def _model_schema(rows: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([rows.schema[k] for k in keys] + [T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("settled", T.BooleanType())])


def fit(train: DataFrame, keys: Sequence[str], loss: str = "logistic", hot_rows: int | None = None) -> DataFrame:
    """One weight vector per group of ``keys``, and whether its steps settled: a group that does not keeps its last weights
    and holds up no other. ``train`` has ``x`` and ``y`` (0/1)."""
    keys = list(keys)
    rows = train.select(*keys, "x", "y")
    hot, n_hot = hot_groups(rows, keys, HOT_TRAIN_ROWS if hot_rows is None else hot_rows)
    one_by_one = lambda df: df.groupBy(*keys).applyInPandas(_fit_group(keys, loss), _model_schema(rows, keys))
    if n_hot == 0:
        return one_by_one(rows)
    small = sized_broadcast(hot, n_hot)
    return one_by_one(rows.join(small, keys, "left_anti")).unionByName(fit_together(rows.join(small, keys, "left_semi"), keys, n_hot, loss))


def fit_together(rows: DataFrame, keys: Sequence[str], groups: int, loss: str, steps: int = DESCENT_STEPS) -> DataFrame:
    """All groups at once. Each pass sums loss, gradient and Hessian at the groups' trial weights per partition; the sums
    of a group, one small row per partition, meet in the update of its weights. Newton steps are halved while the loss
    rises and end, group by group, by the test of ``newton_fit``; descent takes ``steps`` passes."""
    keys = list(keys)
    descent = loss == "descent"
    totals = pin(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_"), F.sum("y").alias("pos_"), F.max(F.size("x")).alias("width_")))
    zeros = F.array_repeat(F.lit(0.0), F.col("width_") + 1)
    state = pin(totals.select(*keys, "rows_", "pos_", zeros.alias("w"), zeros.alias("trial_"), zeros.alias("step_"), F.lit(1.0).alias("size_"),
                              F.lit(float("inf")).alias("value_"), ((F.col("pos_") == 0) | (F.col("pos_") == F.col("rows_"))).alias("done_")))
    held = [c for c in state.columns if c not in keys]
    partial_schema = T.StructType([*state.schema, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("grad_", "hess_")], T.StructField("loss_", T.DoubleType())])

    def partials(batches):
        sums: dict[tuple, list] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                x = np.hstack([np.stack(part["x"].to_numpy()).astype(float), np.ones((len(part), 1))])
                y = np.where(part["y"].to_numpy() == 1, 1.0, -1.0)
                n, pos = float(part["rows_"].iloc[0]), float(part["pos_"].iloc[0])
                s = np.where(y > 0, n / (2.0 * max(pos, 1.0)), n / (2.0 * max(n - pos, 1.0)))
                w = np.asarray(part["trial_"].iloc[0], float)
                kind = "logistic" if descent else loss
                g, h = _sums(x, y, s, w, kind)
                value = float((s * _terms(kind, y * (x @ w))[0]).sum())
                if key in sums:
                    sums[key][0] += g
                    sums[key][1] += h
                    sums[key][2] += value
                else:
                    sums[key] = [g, h, value, part.iloc[0]]
        out = [dict({c: r[c] for c in [*keys, *held]}, grad_=g.tolist(), hess_=h.ravel().tolist(), loss_=v) for g, h, v, r in sums.values()]
        yield pd.DataFrame(out, columns=[*partial_schema.names])

    def update(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[*keys, *held]].head(1).copy()
        w, trial, step = (np.asarray(out[c].iloc[0], float) for c in ("w", "trial_", "step_"))
        size, value, done = float(out["size_"].iloc[0]), float(out["value_"].iloc[0]), False
        g = np.sum(np.stack(pdf["grad_"].to_numpy()), axis=0)
        if descent:
            w = trial = w - 0.05 * (g + np.append(w[:-1], 0.0)) / float(out["rows_"].iloc[0])
        else:
            h = np.sum(np.stack(pdf["hess_"].to_numpy()), axis=0).reshape(len(w), len(w))
            now = 0.5 * trial @ trial + float(pdf["loss_"].sum())
            moved = np.abs(size * step).max()
            if now <= value or size <= 1e-8 or moved < 1e-10:
                # the start has no step yet
                done, w, value, size = bool(np.isfinite(value) and moved < 1e-10), trial, now, 1.0
                step = np.linalg.solve(h + np.eye(len(w)), g + w)
            else:
                size *= 0.5
            trial = w - size * step
        out["w"], out["trial_"], out["step_"] = [w.tolist()], [trial.tolist()], [step.tolist()]
        out["size_"], out["value_"], out["done_"] = size, value, done
        return out

    for _ in range(steps if descent else MOST_PASSES):
        if not state.where("not done_").limit(1).count():
            break
        joined = rows.join(sized_broadcast(state.where("not done_"), groups), keys)
        moved = joined.mapInPandas(partials, partial_schema).groupBy(*keys).applyInPandas(update, state.schema)
        state = pin(moved.unionByName(state.where("done_")))
    one = F.when(F.col("pos_") == 0, -30.0).when(F.col("pos_") == F.col("rows_"), 30.0)
    none = F.transform("w", lambda v: v * 0)
    constant = F.concat(F.slice(none, 1, F.size("w") - 1), F.array(one))
    return state.select(*keys, F.when(one.isNotNull(), constant).otherwise(F.col("w")).alias("w"), (F.col("done_") | F.lit(descent)).alias("settled"))


def linear_score(x: Column, w: Column) -> Column:
    """Dot product plus the trailing intercept, inside the JVM."""
    return F.aggregate(F.zip_with(x, F.slice(w, 1, F.size(x)), lambda a, b: a * b), F.element_at(w, -1), lambda acc, v: acc + v)


def score(test: DataFrame, models: DataFrame, keys: Sequence[str], loss: str = "logistic") -> DataFrame:
    """Score and decision per (run, cause)."""
    out = test.join(models, list(keys)).withColumn("f", linear_score(F.col("x"), F.col("w")))
    found, decision = decided(F.col("f"), loss)
    return out.withColumns({"score": found, "decision": decision})


def fitted_values(vecs: DataFrame, keys: Sequence[str], loss: str) -> DataFrame:
    """Value ``f_<cause>`` of the fitted function at every test run, from ``vectors`` of training and test runs."""
    from .diagnose import LABELS, RUN

    rows = pin(cause_targets(vecs.withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))))))
    models = pin(fit(rows.where("role = 'train'"), [*keys, "cause"], loss))
    scored = score(rows.where("role = 'test'"), models, [*keys, "cause"], loss)
    who = [*keys, *[k for k in RUN if k not in keys], "degree", "truth_set", *LABELS]
    return scored.groupBy(*who).agg(*[F.max(F.when(F.col("cause") == c, F.col("f"))).alias(f"f_{c}") for c in CAUSES])


def decided(f: Column, loss: str) -> tuple[Column, Column]:
    """Score and decision of a value of the fitted function."""
    if loss == "hinge":
        return f, (f > 0).cast("int")
    p = 1 / (1 + F.exp(-f))
    return p, (p >= 0.5).cast("int")


def value_predictions(values: DataFrame, method: str, loss: str) -> DataFrame:
    """Common prediction columns from the values of ``fitted_values``."""
    from .derive import set_key_from_indicators
    from .diagnose import finish_predictions

    each = {c: decided(F.col(f"f_{c}"), loss) for c in CAUSES}
    wide = values.withColumns({f"pred_{c}": d for c, (_, d) in each.items()} | {f"{c.lower()}_score": s for c, (s, _) in each.items()})
    return finish_predictions(wide.withColumns({"predicted_set": set_key_from_indicators("pred_"), "method": F.lit(method)}))


def coefficient_stability(models: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Mean, SD, share positive and sign changes of each coefficient over folds; zeros do not count as a sign."""
    names = F.array(*[F.lit(f) for f in features])
    rows = models.select(*keys, F.explode(F.arrays_zip(names.alias("feature"), F.slice("w", 1, len(features)).alias("coefficient"))).alias("c")).select(*keys, "c.*")
    sign = F.when(F.col("coefficient") != 0, F.signum("coefficient"))
    return rows.groupBy(*keys, "feature").agg(
        F.avg("coefficient").alias("mean"), F.stddev_samp("coefficient").alias("sd"), F.avg((F.col("coefficient") > 0).cast("double")).alias("positive_fraction"),
        (F.min(sign) != F.max(sign)).cast("int").alias("sign_changed"))
