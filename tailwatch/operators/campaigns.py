"""Leave-one-repetition-out diagnosis of one campaign's runs in the task that holds them.

Runs come as ``feature_vectors``: a row each, features an array. They are dealt once, by campaign; folds, tiers, protocols
and causes multiply them inside the task, so that neither shuffles nor written tables hold a row more than once a result.
Campaigns of more than ``MOST_RUNS`` runs are not for one task: callers send them down the row route of ``diagnose``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import NUMERICAL_FLOOR
from .design import CAUSES
from .diagnose import FULL_METHODS, GROUPS, LABELS, PAIRS, RUN, SCORES, SEPARATION, VARIANCE_FLOOR, Z_LIMIT, _matrix, _mean, _score_matrix
from .learners import DESCENT_STEPS, _terms

#: Most runs of a campaign whose folds are judged in one task.
MOST_RUNS = 5_000
#: Numbers in one block of differences between runs.
BLOCK = 4_000_000
WHO = [*RUN, "degree", "truth_set", *LABELS]
EVIDENCE_METHODS = ("D4-S", "D4-SM", "D4-SMT", *FULL_METHODS)


def large_campaigns(runs: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """Campaigns with more than ``most`` runs, and how many there are."""
    large = runs.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (MOST_RUNS if most is None else most)).select("campaign_id")
    return large, large.count()


def _each_campaign(vectors: DataFrame, judge: Callable[[pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    # a campaign is some hundredths of a second of work and few bytes, so campaigns spread by their number
    tasks = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return vectors.repartition(tasks, "campaign_id").groupBy("campaign_id").applyInArrow(judge, schema)


def _schema(vectors: DataFrame, kept: Sequence[str], further: str) -> T.StructType:
    fold = T.StructField("fold", vectors.schema["repetition"].dataType)
    return T.StructType([*[vectors.schema[c] for c in kept], fold, *T._parse_datatype_string(further).fields])


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _train(table: pa.Table, fold, protocol: str) -> np.ndarray:
    other = _ints(table, "repetition") != fold
    return np.flatnonzero(other & (_ints(table, "degree") <= 1) if protocol == "P1" else other)


def _scale(x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``scaling`` of training rows: median, and mean and SD after imputation; NaN for features without a value."""
    n = there.sum(axis=0)
    order, at = np.sort(np.where(there, x, np.nan), axis=0), np.maximum(n - 1, 0) / 2
    low, high = (np.take_along_axis(order, f(at).astype(int)[None], 0)[0] for f in (np.floor, np.ceil))
    fill = np.where(n > 0, np.where(at % 1 == 0, low, (low + high) / 2), np.nan)
    # about the median, so that equal values have no spread at all
    rest = np.where(there, x, fill) - fill
    sd = rest.std(axis=0)
    return fill, fill + rest.mean(axis=0), np.where(sd <= NUMERICAL_FLOOR, 1.0, sd)


def _folds(table: pa.Table, width: int, protocols: Sequence[str]) -> Iterator[tuple]:
    """Fold, protocol, training and test rows, and all rows standardised by the training ones, for every fold that trains."""
    x, there = _matrix(table.column("x").combine_chunks(), width)
    for fold in np.unique(_ints(table, "repetition")):
        test = np.flatnonzero(_ints(table, "repetition") == fold)
        for protocol in protocols:
            train = _train(table, fold, protocol)
            if len(train):
                fill, mu, sd = _scale(x[train], there[train])
                yield fold, protocol, train, test, (np.where(there, x, fill) - mu) / sd


def _closest(a: np.ndarray, b: np.ndarray, tiers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``b`` and distance of the closest row to each row of ``a``, the first of equals, a column a tier."""
    place, least = (np.empty((len(a), tiers.shape[1]), t) for t in (int, float))
    step = max(1, BLOCK // b.size)
    for i in range(0, len(a), step):
        square = (a[i:i + step, None] - b) ** 2
        d = np.sqrt(np.where(np.isnan(square), 0.0, square) @ tiers)
        place[i:i + step] = d.argmin(axis=1)
        least[i:i + step] = np.take_along_axis(d, place[i:i + step][:, None], 1)[:, 0]
    return place, least


def _finished(table: pa.Table, kept: Sequence[str], rows: list[np.ndarray], columns: Mapping[str, list], schema: T.StructType) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    base = table.select(list(kept)).take(pa.array(np.concatenate([np.empty(0, int), *rows])))
    for name, parts in columns.items():
        base = base.append_column(name, pa.array([v for p in parts for v in p], kinds[schema[name].dataType.simpleString()]))
    return base.select(schema.names)


def closest_sets(vectors: DataFrame, features: Sequence[str], tiers: Mapping[str, Sequence[str]], protocols: Sequence[str] = ("P1",)) -> DataFrame:
    """``nearest_centroid`` (method M1) and ``nearest_neighbour`` (M0) of every test run, tier and protocol."""
    features, names = list(features), list(tiers)
    member = np.array([[float(f in tiers[t]) for t in names] for f in features])
    schema = _schema(vectors, WHO, "tier string, protocol string, method string, predicted_set string, neighbour_id string, score double")

    def judge(table: pa.Table) -> pa.Table:
        sets, ids = (np.array(table.column(c).to_pylist(), object) for c in ("truth_set", "run_id"))
        rows, out = [], {c: [] for c in schema.names if c not in WHO}
        for fold, protocol, train, test, z in _folds(table, len(features), protocols):
            train = train[np.argsort(ids[train], kind="stable")]
            cells = sorted(set(sets[train]))
            with np.errstate(all="ignore"):
                centres = np.stack([z[train[sets[train] == c]].mean(axis=0) for c in cells])
                cell, far = _closest(z[test], centres, member)
                near, away = _closest(z[test], z[train], member)
            for t, tier in enumerate(names):
                for method, found, who, d in (("M1", [cells[i] for i in cell[:, t]], [None] * len(test), far[:, t]),
                                              ("M0", sets[train[near[:, t]]], ids[train[near[:, t]]], away[:, t])):
                    rows.append(test)
                    for name, values in (("fold", [fold] * len(test)), ("tier", [tier] * len(test)), ("protocol", [protocol] * len(test)),
                                         ("method", [method] * len(test)), ("predicted_set", found), ("neighbour_id", who), ("score", -d)):
                        out[name].append(values)
        return _finished(table, WHO, rows, out, schema)

    return _each_campaign(vectors, judge, schema)


# --- evidence -------------------------------------------------------------------------------------


def _spread(v: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, mean and sample SD of each column's present values; zero SD for one value, NaN means for none."""
    n = there.sum(axis=0)
    first = v[there.argmax(axis=0), np.arange(v.shape[1])]
    rest = np.where(there, v - first, 0.0)
    mean = np.where(n > 0, rest.sum(axis=0) / np.maximum(n, 1), np.nan)
    sd = np.sqrt(np.where(there, (rest - mean) ** 2, 0.0).sum(axis=0) / np.maximum(n - 1, 1))
    return n, first + mean, np.where(n > 1, sd, 0.0)


def fitted_evidence(x: np.ndarray, there: np.ndarray, label: np.ndarray, train: np.ndarray) -> tuple[dict, dict, tuple]:
    """Directions of ``PAIRS`` and statistics of group scores over the training runs, and the scores of every run.

    ``x`` has a column a pair of ``PAIRS``, ``label`` one a cause.
    """
    own = label[:, [CAUSES.index(c) for c, _ in PAIRS]] == 1
    v, p, o = x[train], there[train], own[train]
    (n, _, gsd), (n1, mp, _), (n0, ma, asd) = _spread(v, p), _spread(v, p & o), _spread(v, p & ~o)
    known = (n > 1) & (n1 > 0) & (n0 > 0) & ~(gsd < NUMERICAL_FLOOR) & ~(np.abs(mp - ma) < SEPARATION * gsd)
    meta = {"dir": np.where(mp > ma, 1.0, -1.0), "mu0": ma, "sigma": np.maximum(np.maximum(asd, VARIANCE_FLOOR * gsd), NUMERICAL_FLOOR), "known": known}
    present = there & known
    z = meta["dir"] * (x - ma) / meta["sigma"]
    z = np.where(present, np.clip(np.where(np.isnan(z), Z_LIMIT, z), -Z_LIMIT, Z_LIMIT), 0.0)
    value, has = (a.reshape(len(x), len(SCORES) * len(GROUPS)) for a in _score_matrix(z, present))
    absent = np.repeat(label[:, [CAUSES.index(c) for _, c in SCORES]] == 0, len(GROUPS), axis=1)
    some = has.reshape(len(x), len(SCORES), len(GROUPS))[..., :3].any(axis=2)
    counted = has[train] & np.repeat(some[train], len(GROUPS), axis=1)
    (_, _, whole), (n0, mu, own_sd) = _spread(value[train], counted), _spread(value[train], counted & absent[train])
    stats = {"mu": mu, "sg": np.maximum(np.maximum(own_sd, VARIANCE_FLOOR * whole), NUMERICAL_FLOOR), "known": n0 > 0, "fitted": some[train].any(axis=0)}
    return meta, stats, (value, has, some)


def _fold_evidence(x: np.ndarray, there: np.ndarray, label: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """E of every run, method and cause under statistics of the training runs, and where it exists."""
    _, stats, (value, has, some) = fitted_evidence(x, there, label, train)
    shape = (len(x), len(SCORES), len(GROUPS))
    there_n = (has & stats["known"]).reshape(shape)
    norm = np.where(there_n, ((value - stats["mu"]) / stats["sg"]).reshape(shape), 0.0)
    part = lambda rows, *groups: _mean([norm[:, rows, GROUPS.index(g)] for g in groups], [there_n[:, rows, GROUPS.index(g)] for g in groups])[0]
    plain, direct = ([i for i, (f3, _) in enumerate(SCORES) if f3 == k] for k in (0, 1))
    full = lambda rows: part(rows, "S", "M", "T") - part(rows, "X")
    fitted = some & stats["fitted"]
    e = [part(plain, "S"), part(plain, "S", "M"), part(plain, "S_pos", "M_pos", "T_pos"), full(plain), full(direct)]
    return np.stack(e, axis=1), np.stack([fitted[:, plain]] * 4 + [fitted[:, direct]], axis=1)


def _quantile(values: np.ndarray, q: float) -> float:
    values = np.sort(values)
    at = (len(values) - 1) * q
    low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
    return low if at == int(at) else low * (np.ceil(at) - at) + high * (at - np.floor(at))


def evidence_margins(vectors: DataFrame, features: Sequence[str], q: float = 0.95) -> DataFrame:
    """Evidence over its threshold of every test run and method (P1), a column a cause: ``ranked_sets`` before the ranking."""
    features = list(features)
    place = [features.index(f) for _, f in PAIRS]
    schema = _schema(vectors, WHO, "q double, method string, role string, " + ", ".join(f"m_{c} double" for c in CAUSES))

    def judge(table: pa.Table) -> pa.Table:
        x, there = (a[:, place] for a in _matrix(table.column("x").combine_chunks(), len(features)))
        label = np.stack([_ints(table, c) for c in LABELS], axis=1)
        rows, out = [], {c: [] for c in schema.names if c not in WHO}
        for fold in np.unique(_ints(table, "repetition")):
            train, test = _train(table, fold, "P1"), np.flatnonzero(_ints(table, "repetition") == fold)
            if not len(train):
                continue
            with np.errstate(all="ignore"):
                e, exists = _fold_evidence(x, there, label, train)
            for m, method in enumerate(EVIDENCE_METHODS):
                margins = []
                for c in range(len(CAUSES)):
                    clean = train[exists[train, m, c] & (label[train, c] == 0)]
                    tau = _quantile(e[clean, m, c], q) if len(clean) else None
                    margins.append([float(e[i, m, c] - tau) if tau is not None and exists[i, m, c] else None for i in test])
                kept = [k for k in range(len(test)) if any(v[k] is not None for v in margins)]
                rows.append(test[kept])
                for name, value in (("fold", fold), ("q", q), ("method", method), ("role", "test")):
                    out[name].append([value] * len(kept))
                for c, values in zip(CAUSES, margins, strict=True):
                    out[f"m_{c}"].append([values[k] for k in kept])
        return _finished(table, WHO, rows, out, schema)

    return _each_campaign(vectors, judge, schema)


# --- linear fits ----------------------------------------------------------------------------------


def _newton(x: np.ndarray, y: np.ndarray, s: np.ndarray, loss: str, most_steps: int) -> tuple[np.ndarray, np.ndarray]:
    """``damped_newton`` of all (fold, cause) pairs at once; each halves its own steps and stands still once it has settled."""
    folds, _, width = x.shape
    w, open_ = np.zeros((folds, y.shape[2], width)), np.ones((folds, y.shape[2]), bool)
    across = np.swapaxes(x, 1, 2)
    margin = lambda v: y * (x @ np.swapaxes(v, 1, 2))
    value = lambda v: 0.5 * (v * v).sum(axis=2) + (s * _terms(loss, margin(v))[0]).sum(axis=1)
    for _ in range(most_steps):
        _, d1, d2 = _terms(loss, margin(w))
        slope = np.swapaxes(across @ (s * d1 * y), 1, 2) + w
        bend = np.swapaxes(s * d2, 1, 2)[..., None]
        step = np.linalg.solve(across[:, None] @ (x[:, None] * bend) + np.eye(width), slope[..., None])[..., 0]
        size, now = open_.astype(float), value(w)
        while (high := (size > 1e-8) & (value(w - size[..., None] * step) > now)).any():
            size[high] *= 0.5
        move = size[..., None] * step
        w, open_ = w - move, open_ & (np.abs(move).max(axis=2) >= 1e-10)
        if not open_.any():
            break
    return w, ~open_


def _descent(x: np.ndarray, y: np.ndarray, s: np.ndarray, n: np.ndarray, steps: int) -> np.ndarray:
    """``descent_fit`` of all (fold, cause) pairs at once; the last weight, the intercept, is not penalised."""
    t, across, held = (y > 0).astype(float), np.swapaxes(x, 1, 2), np.ones((x.shape[2], 1))
    held[-1] = 0.0
    w = np.zeros((len(x), x.shape[2], y.shape[2]))
    for _ in range(steps):
        r = s * (1.0 / (1.0 + np.exp(-np.clip(x @ w, -500, 500))) - t)
        w = w - 0.05 * (across @ r + held * w) / n
    return np.swapaxes(w, 1, 2)


def fold_fits(rows: Sequence[np.ndarray], labels: Sequence[np.ndarray], loss: str, most_steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Balanced fits of every fold and cause: weights (fold, cause, feature; the intercept last), and whether they settled.

    A fold is a matrix of features and one of labels (-1 or +1, a column a cause). One class only gives a constant answer.
    """
    sizes = np.array([len(r) for r in rows], float)[:, None, None]
    longest, width, causes = int(sizes.max()), rows[0].shape[1], labels[0].shape[1]
    # rows that fill up a shorter fold weigh nothing
    x, y, s = np.zeros((len(rows), longest, width + 1)), np.ones((len(rows), longest, causes)), np.zeros((len(rows), longest, causes))
    pos = np.stack([(v > 0).sum(axis=0) for v in labels])
    both = (pos > 0) & (pos < sizes[:, 0])
    for i, (r, v) in enumerate(zip(rows, labels, strict=True)):
        x[i, :len(r), :-1], x[i, :len(r), -1], y[i, :len(r)] = r, 1.0, v
        s[i, :len(r)] = np.where(both[i], np.where(v > 0, len(r) / (2.0 * np.maximum(pos[i], 1)), len(r) / (2.0 * np.maximum(len(r) - pos[i], 1))), 0.0)
    w, settled = (_descent(x, y, s, sizes, DESCENT_STEPS), np.ones(both.shape, bool)) if loss == "descent" else _newton(x, y, s, loss, most_steps)
    w[~both] = 0.0
    w[~both, -1] = 30.0 * y[:, 0][~both]
    return w, settled


def _fitted(table: pa.Table, features: list[str], tiers: Mapping[str, Sequence[str]], protocols: Sequence[str], loss: str) -> Iterator[tuple]:
    y = np.where(np.stack([_ints(table, c) for c in LABELS], axis=1) == 1, 1.0, -1.0)
    for protocol in protocols:
        folds = _folds(table, len(features), (protocol,))
        # so many folds at once as their rows and Hessians leave small
        at_once = max(1, BLOCK // (len(CAUSES) * (len(features) + 1) * (table.num_rows + len(features) + 1)))
        while some := list(islice(folds, at_once)):
            for tier, members in tiers.items():
                place = [features.index(f) for f in members]
                own = [np.where(np.isnan(z), 0.0, z)[:, place] for *_, z in some]
                w, settled = fold_fits([z[train] for z, (_, _, train, _, _) in zip(own, some, strict=True)], [y[train] for _, _, train, _, _ in some], loss)
                for i, (fold, _, _, test, _) in enumerate(some):
                    yield fold, protocol, tier, test, own[i], w[i], settled[i]


def linear_models(vectors: DataFrame, features: Sequence[str], loss: str) -> DataFrame:
    """``learners.fit`` of every fold and cause (P1) on all ``features``."""
    features, tiers = list(features), {"": list(features)}
    schema = _schema(vectors, ["campaign_id"], "cause string, w array<double>, settled boolean")

    def judge(table: pa.Table) -> pa.Table:
        found = [(fold, c, w[i].tolist(), bool(settled[i])) for fold, _, _, _, _, w, settled in _fitted(table, features, tiers, ("P1",), loss) for i, c in enumerate(CAUSES)]
        base = table.select(["campaign_id"]).take(pa.array(np.zeros(len(found), int)))
        kinds = {"fold": table.schema.field("repetition").type, "cause": pa.string(), "w": pa.list_(pa.float64()), "settled": pa.bool_()}
        for i, (name, kind) in enumerate(kinds.items()):
            base = base.append_column(name, pa.array([r[i] for r in found], kind))
        return base

    return _each_campaign(vectors, judge, schema)


def linear_values(vectors: DataFrame, features: Sequence[str], loss: str, tiers: Mapping[str, Sequence[str]], protocols: Sequence[str] = ("P1",)) -> DataFrame:
    """Value ``f_<cause>`` of the fitted function at every test run, for each tier and protocol."""
    features = list(features)
    schema = _schema(vectors, WHO, "tier string, protocol string, " + ", ".join(f"f_{c} double" for c in CAUSES))

    def judge(table: pa.Table) -> pa.Table:
        rows, out = [], {c: [] for c in schema.names if c not in WHO}
        for fold, protocol, tier, test, x, w, _ in _fitted(table, features, tiers, protocols, loss):
            rows.append(test)
            value = x[test] @ w[:, :-1].T + w[:, -1]
            for name, values in (("fold", [fold] * len(test)), ("tier", [tier] * len(test)), ("protocol", [protocol] * len(test)),
                                 *[(f"f_{c}", value[:, i]) for i, c in enumerate(CAUSES)]):
                out[name].append(values)
        return _finished(table, WHO, rows, out, schema)

    return _each_campaign(vectors, judge, schema)
