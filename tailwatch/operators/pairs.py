"""Degraded telemetry of a pair of campaigns, judged in the task that holds the pair's requests.

A pair is a source campaign and its target. Its requests are dealt once; features of the runs, models of the folds, draws,
masks and points of the grid are arrays in that task, and what leaves it are counts of predicted sets. Pairs too large for a
task are not for this module: callers send them down the row route of ``degrade`` and ``diagnose``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import floor, fmod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import portable_normals, portable_uniforms
from .campaigns import BLOCK, _quantile, _scale, _spread, fitted_evidence
from .degrade import DELAY_LEVELS, MISSING_LEVELS, NOISE_LEVELS, SAMPLING_LEVELS
from .derive import prefill_proxy
from .design import CAUSES, CAUSE_SETS
from .diagnose import CELLS, FULL_METHODS, GROUPS, META, PAIRS, SCORES, _full_margins, _nearest_cell
from .features import F2, LOST_CHANNELS, NONNEGATIVE_TOKENS

#: Most requests and most runs of a pair whose grid is judged in one task.
MOST_REQUESTS, MOST_RUNS = 200_000, 5_000
METHODS = ("M1/F2", *FULL_METHODS)
RUN = ["campaign_id", "condition_id", "repetition", "run_id"]
TIMES = ["actual_arrival", "first_token_time", "completion_time", "gateway_receive_time", "gateway_completion_time", "dependency_start_time", "dependency_end_time", "llama_dispatch_time"]
VALUES = [*TIMES, "prefill_proxy", "dependency_duration", "scheduler_slip", "server_prompt_tokens", "server_output_tokens", "host_cpu_percent"]
#: Rows scored at once.
ROWS = 4096
#: A column of values and which of them are there.
Held = tuple[np.ndarray, np.ndarray]


def pair_of(campaign="campaign_id"):
    return F.floor(F.col(campaign) / 2).cast("bigint").alias("pair_id")


def pair_requests(requests: DataFrame) -> DataFrame:
    """What the grid reads of a request, a row each: ``requests`` carry the host sample ``host_cpu_percent`` beside them."""
    columns = {"prefill_proxy": prefill_proxy()}
    values = [columns.get(c, F.col(c)).cast("double").alias(c) for c in VALUES]
    ordinal = F.regexp_extract("request_id", r"-(\d+)$", 1).cast("bigint").alias("ordinal")
    return requests.select(pair_of(), *RUN, ordinal, (F.col("status") == "success").alias("ok"), *values)


# --- runs -----------------------------------------------------------------------------------------


def _less(a: Held, b: Held) -> Held:
    there = a[1] & b[1]
    return np.where(there, a[0] - b[0], 0.0), there


def _only(a: Held, rows: np.ndarray) -> Held:
    return a[0], a[1] & rows


def _ratio(a: Held, b: Held) -> Held:
    there = a[1] & b[1] & (b[0] != 0)
    return np.divide(a[0], b[0], out=np.zeros_like(a[0]), where=there), there


def percentiles(v: np.ndarray, there: np.ndarray, probs: Sequence[float]) -> list[Held]:
    """Exact interpolated percentiles of the present values along the last axis."""
    n = there.sum(axis=-1)
    order = np.sort(np.where(there, v, np.nan), axis=-1)
    out = []
    for p in probs:
        at = np.maximum(n - 1, 0) * p
        low, high = np.floor(at), np.ceil(at)
        if not v.shape[-1]:
            out.append((np.zeros(n.shape), n > 0))
            continue
        a, b = (np.take_along_axis(order, i.astype(int)[..., None], -1)[..., 0] for i in (low, high))
        out.append((np.where(low == high, a, (high - at) * a + (at - low) * b), n > 0))
    return out


def _change(early: Held, late: Held) -> Held:
    (e,), (l,) = percentiles(*early, (0.5,)), percentiles(*late, (0.5,))
    return _less(l, e)


def _rise(v: np.ndarray, there: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Least-squares slope of the present values over ``x``."""
    n = np.maximum(there.sum(axis=-1, keepdims=True), 1)
    dx = np.where(there, x - np.where(there, x, 0.0).sum(axis=-1, keepdims=True) / n, 0.0)
    # about the first, so that equal values have no slope at all
    first = np.take_along_axis(v, there.argmax(axis=-1)[..., None], -1)
    return (dx * np.where(there, v - first, 0.0)).sum(axis=-1) / (dx * dx).sum(axis=-1)


def fixed_trend(v: np.ndarray, there: np.ndarray, window: int = 10) -> tuple[Held, Held]:
    """Change between the first and last ``window`` positions, and slope over positions scaled to [0, 1] where none is missing."""
    n = v.shape[-1]
    change = _change((v[..., :window], there[..., :window]), (v[..., max(0, n - window):], there[..., max(0, n - window):]))
    whole = there.all(axis=-1) & (n >= 2)
    slope = _rise(v, there, np.arange(n, dtype=float)) * (n - 1) if n >= 2 else np.zeros(whole.shape)
    return change, (slope, whole)


def quarter_trend(v: np.ndarray, there: np.ndarray, n: int | None = None, late_by: int = 0) -> tuple[Held, Held]:
    """The same over quarters of ``n`` positions, missing values skipped; none where two quarters do not fit. Values stand
    ``late_by`` positions behind the place that they have in the array."""
    n = v.shape[-1] if n is None else n
    q = max(3, floor(n * 0.25))
    if n < 2 * q:
        none = np.zeros(v.shape[:-1]), np.zeros(v.shape[:-1], bool)
        return none, none
    early, late = slice(0, max(0, q - late_by)), slice(max(0, n - q - late_by), None)
    change = _change((v[..., early], there[..., early]), (v[..., late], there[..., late]))
    rank = np.cumsum(there, axis=-1)
    return change, (_rise(v, there, rank.astype(float)) * (rank[..., -1] - 1), rank[..., -1] >= 2)


#: Series whose trend is a feature.
SERIES = ["ttft", "total_latency", "post_first_token_duration", "prefill_proxy", "dependency_duration", "scheduler_slip", "llama_span_duration", "dependency_span_duration"]
TRENDS = [f"{m}_{s}" for m in SERIES for s in ("late_minus_early", "normalized_slope")]


@dataclass
class Runs:
    """Runs of one campaign and number of requests: their keys, features (``x`` and ``there``, a row a run) and series (run, metric, position)."""

    condition: list[str]
    repetition: np.ndarray
    run_id: list[str]
    x: np.ndarray
    there: np.ndarray
    ordinals: np.ndarray
    series: Held


def _latest_spans(c: dict[str, Held], run: np.ndarray, ordinal: np.ndarray) -> tuple[dict[str, Held], np.ndarray]:
    """Span durations of every row, and the rows that stand for a traced request; of a request's rows the latest span wins."""
    timed = np.logical_and.reduce([c[t][1] for t in TIMES[3:]])
    kinds = {"gateway": ("gateway_receive_time", "gateway_completion_time"), "dependency": ("dependency_start_time", "dependency_end_time"), "llama": ("llama_dispatch_time", "gateway_completion_time")}
    spans = {k: _only(_less(c[end], c[start]), timed) for k, (start, end) in kinds.items()}
    again = (run[1:] == run[:-1]) & (ordinal[1:] == ordinal[:-1])
    if not again.any():
        return spans, timed
    request = np.concatenate([[0], np.cumsum(~again)])
    for k, (start, _) in kinds.items():
        rows = np.flatnonzero(spans[k][1])
        rows = rows[np.lexsort((c[start][0][rows], request[rows]))]
        value, there = np.zeros(request[-1] + 1), np.zeros(request[-1] + 1, bool)
        value[request[rows]], there[request[rows]] = spans[k][0][rows], True
        spans[k] = value[request], there[request]
    return spans, np.concatenate([[True], ~again]) & spans["gateway"][1]


def campaign_runs(table: pa.Table, known: Mapping[str, object], features: Sequence[str]) -> dict[int, list[Runs]]:
    """Runs of each campaign with their features, runs of one length together. Rows without a run's keys belong to none."""
    for name in RUN:
        if table.column(name).null_count:
            table = table.filter(pc.is_valid(table.column(name)))
    names = {k: table.column(k).combine_chunks().dictionary_encode() for k in ("condition_id", "run_id")}
    codes = {k: v.indices.to_numpy() for k, v in names.items()}
    campaign, repetition = (table.column(k).to_numpy() for k in ("campaign_id", "repetition"))
    ordinal = table.column("ordinal").fill_null(-1).to_numpy()
    order = np.lexsort((ordinal, codes["run_id"], codes["condition_id"], repetition, campaign))
    campaign, repetition, ordinal, condition, run_id = (a[order] for a in (campaign, repetition, ordinal, codes["condition_id"], codes["run_id"]))
    edge = np.ones(len(order), bool)
    edge[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in (campaign, repetition, condition, run_id)])
    starts, run = np.flatnonzero(edge), np.cumsum(edge) - 1
    c = {}
    for name in VALUES:
        column = table.column(name).combine_chunks()
        c[name] = column.fill_null(0.0).to_numpy(zero_copy_only=False)[order], column.is_valid().to_numpy(zero_copy_only=False)[order]
    ok = table.column("ok").fill_null(False).combine_chunks().to_numpy(zero_copy_only=False)[order]
    arrival, first, done = (c[t] for t in TIMES[:3])
    spans, traced = _latest_spans(c, run, ordinal)
    rows = {
        "ttft": _less(first, arrival), "total_latency": _less(done, arrival), "post_first_token_duration": _less(done, first),
        **{k: c[k] for k in ("prefill_proxy", "dependency_duration", "scheduler_slip")}, **{f"{k}_span_duration": v for k, v in spans.items()}}
    own = lambda name: _only(rows[name], traced)
    columns = {
        **{k: _only(rows[k], ok) for k in ("ttft", "total_latency", "post_first_token_duration", "dependency_duration")}, "scheduler_slip": c["scheduler_slip"],
        **{k: _only(c[k], ok) for k in ("server_prompt_tokens", "server_output_tokens")}, "host_cpu": c["host_cpu_percent"], "prefill_proxy": c["prefill_proxy"],
        **{f"{k}_span_duration": own(f"{k}_span_duration") for k in spans},
        **{f"{k}_fraction_of_gateway": _ratio(own(f"{k}_span_duration"), own("gateway_span_duration")) for k in ("dependency", "llama")}}
    kept = {k: [p for p in ("median", "p95") if f"{k}_{p}" in features] for k in columns}
    names_of = {k: v.dictionary.to_pylist() for k, v in names.items()}
    sizes = np.diff(np.append(starts, len(order)))
    listed = np.array([n in known for n in names_of["condition_id"]], bool)[condition[starts]] if len(starts) else np.empty(0, bool)
    out: dict[int, list[Runs]] = {}
    for number in np.unique(campaign[starts]):
        here = (campaign[starts] == number) & listed
        for n in np.unique(sizes[here]):
            some = np.flatnonzero(here & (sizes == n))
            place = starts[some][:, None] + np.arange(n)
            at = lambda held: (held[0][place], held[1][place])
            found = {f"{k}_{p}": v for k, ps in kept.items() if ps for p, v in zip(ps, percentiles(*at(columns[k]), [{"median": 0.5, "p95": 0.95}[p] for p in ps]), strict=True)}
            end, start = (_edge_of(at(held), f) for held, f in ((_only(done, ok), np.fmax), (arrival, np.fmin)))
            span, both = _less(end, start)
            moves = both & ~(span <= 0)
            found["successful_requests_per_second"] = np.divide(ok[place].sum(axis=1), span, out=np.zeros(len(some)), where=moves), moves
            series = tuple(np.stack([at(rows[m])[i] for m in SERIES], axis=1) for i in (0, 1))
            (change, has_change), (slope, has_slope) = fixed_trend(*series)
            for i, m in enumerate(SERIES):
                found[f"{m}_late_minus_early"], found[f"{m}_normalized_slope"] = (change[:, i], has_change[:, i]), (slope[:, i], has_slope[:, i])
            first_rows = starts[some]
            out.setdefault(int(number), []).append(Runs(
                [names_of["condition_id"][i] for i in condition[first_rows]], repetition[first_rows], [names_of["run_id"][i] for i in run_id[first_rows]],
                np.stack([found[f][0] for f in features], axis=1), np.stack([found[f][1] for f in features], axis=1), ordinal[place], series))
    return out


def _edge_of(held: Held, f) -> Held:
    """Largest or smallest present value of each row."""
    limit = -np.inf if f is np.fmax else np.inf
    return f.reduce(np.where(held[1], held[0], limit), axis=1), held[1].any(axis=1)


# --- models ---------------------------------------------------------------------------------------


def model(x: np.ndarray, there: np.ndarray, label: np.ndarray, sets: np.ndarray, train: np.ndarray, near: Sequence[int], place: Sequence[int]) -> dict[str, Held]:
    """What ``diagnose.model_vectors`` holds of one model, fitted on the rows ``train``: arrays of one row and which entries are there."""
    meta, stats, (value, has, some) = fitted_evidence(x[:, place], there[:, place], label, train)
    row = lambda v, k: (np.asarray(v, float)[None], np.asarray(k, bool)[None])
    out = {m: row(meta[m], meta["known"]) for m in META}
    out["stat_mu"], out["stat_sg"] = row(stats["mu"], stats["known"]), row(stats["sg"], np.repeat(stats["fitted"], len(GROUPS)))
    out["tau"] = np.zeros((1, len(SCORES))), np.ones((1, len(SCORES)), bool)
    e, exists = _full_margins(x[train][:, place], there[train][:, place], out)
    tau, cut = np.zeros(len(SCORES)), np.zeros(len(SCORES), bool)
    for i, (_, cause) in enumerate(SCORES):
        clean = exists[:, i] & (label[train, CAUSES.index(cause)] == 0)
        if clean.any():
            tau[i], cut[i] = _quantile(e[clean, i], 0.95), True
    out["tau"] = row(tau, cut)
    own, present = x[train][:, near], there[train][:, near]
    fill, mu, sd = _scale(own, present)
    filled = present.any(axis=0)
    z = (np.where(present, own, fill) - mu) / sd
    cells = [sets[train] == c for c in CELLS]
    out |= {"fill": row(fill, filled), "scale_mu": row(mu, filled), "scale_sd": row(sd, np.ones(len(near)))}
    out["centres"] = row(np.concatenate([z[c].mean(axis=0) if c.any() else np.zeros(len(near)) for c in cells]), np.concatenate([filled & c.any() for c in cells]))
    return out


# --- points ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Grid:
    """Seeds of the drawn families (the target's are a hundred higher) and the families to judge."""

    missing: Sequence[int]
    sampling: Sequence[int]
    noise: Sequence[int]
    families: Sequence[str] = ("clean", "missingness", "noise", "channel_loss", "temporal_sampling", "delay")

    def points(self, shift: int) -> list[tuple]:
        """Family, severity, seed and lost channel of each point, in the order of ``degraded``."""
        drawn = lambda family, seeds, levels: [(family, float(level), s + shift, None) for s in seeds for level in levels]
        by = {
            "clean": [("clean", None, None, None)], "missingness": drawn("missingness", self.missing, MISSING_LEVELS), "noise": drawn("noise", self.noise, NOISE_LEVELS),
            "channel_loss": [("channel_loss", None, None, c) for c in LOST_CHANNELS], "temporal_sampling": drawn("temporal_sampling", self.sampling, SAMPLING_LEVELS),
            "delay": [("delay", float(d), None, None) for d in DELAY_LEVELS]}
        return [p for f in self.families for p in by[f]]


def kept_positions(ordinals: np.ndarray, run_id: Sequence[str], seeds: Sequence[int]) -> np.ndarray:
    """Positions of each run's requests in the order in which a seed draws them: (run, seed, position)."""
    u = np.empty((len(run_id), len(seeds), ordinals.shape[1]))
    _, which = np.unique(ordinals, axis=0, return_inverse=True)
    for k in range(which.max() + 1):
        own = np.flatnonzero(which.ravel() == k)
        u[own] = portable_uniforms(seeds, [run_id[i] for i in own], [str(o) for o in ordinals[own[0]]])
    return np.argsort(u, axis=-1, kind="stable")


def _replaced(runs: Runs, trend: tuple[Held, Held], features: Sequence[str]) -> Held:
    """A run's features with the trends of a degraded order in the place of its own; the axes of the trend but the last, the metric, lead."""
    lead = trend[0][0].shape[:-1]
    x, there = (np.broadcast_to(a.reshape(a.shape[0], *[1] * (len(lead) - 1), a.shape[1]), (*lead, a.shape[1])).copy() for a in (runs.x, runs.there))
    for (value, has), stat in zip(trend, ("late_minus_early", "normalized_slope"), strict=True):
        for i, m in enumerate(SERIES):
            if f"{m}_{stat}" in features:
                at = features.index(f"{m}_{stat}")
                x[..., at], there[..., at] = value[..., i], has[..., i]
    return x, there


def degraded(runs: Runs, grid: Grid, shift: int, noise_sd: Held, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of runs at every point, which of them are there, and the points that a run has: (run, point, feature) and (run, point)."""
    features, (x, there), rows = list(features), (runs.x, runs.there), len(runs.run_id)
    values, present, has = [], [], []

    def add(v, t, known=True):
        values.append(v.reshape(rows, -1, len(features)))
        present.append(np.broadcast_to(t, v.shape).reshape(rows, -1, len(features)))
        has.append(np.full(values[-1].shape[:2], known))

    n = runs.series[0].shape[-1]
    for family in grid.families:
        if family == "clean":
            add(x, there)
        elif family == "missingness":
            u = portable_uniforms([s + shift for s in grid.missing], runs.run_id, features)
            left = np.stack([u >= level for level in MISSING_LEVELS], axis=2) & there[:, None, None]
            add(np.broadcast_to(x[:, None, None], left.shape), left)
        elif family == "noise":
            u = portable_normals([s + shift for s in grid.noise], runs.run_id, features)
            scale = noise_sd[0] * np.array(NOISE_LEVELS)[:, None]
            moved = x[:, None, None] + scale * u[:, :, None]
            floored = np.array([any(t in f for t in NONNEGATIVE_TOKENS) for f in features])
            moved = np.where(floored, np.maximum(0.0, moved), moved)
            moved = np.where(noise_sd[1] & ~(scale <= 0), moved, x[:, None, None])
            add(moved, there[:, None, None])
        elif family == "channel_loss":
            lost = np.array([[f in gone for f in features] for gone in LOST_CHANNELS.values()])
            add(np.broadcast_to(x[:, None], (rows, *lost.shape)), there[:, None] & ~lost)
        elif family == "temporal_sampling":
            order = kept_positions(runs.ordinals, runs.run_id, [s + shift for s in grid.sampling])
            parts = []
            for level in SAMPLING_LEVELS:
                kept = np.sort(order[..., :max(1, int(np.rint(n * level)))], axis=-1)[:, :, None]
                held = tuple(np.take_along_axis(a[:, None], kept, -1) for a in runs.series)
                parts.append(_replaced(runs, quarter_trend(*held), features))
            add(*(np.stack(part, axis=2) for part in zip(*parts, strict=True)))
        else:
            for d in DELAY_LEVELS:
                if d < n:
                    add(*_replaced(runs, quarter_trend(*(a[..., :n - d] for a in runs.series), n, d), features))
                else:
                    add(x, there, False)
    return np.concatenate(values, axis=1), np.concatenate(present, axis=1), np.concatenate(has, axis=1)


_BY_RANK = sorted(CAUSE_SETS, key=lambda s: (len(s), "+".join(s) if s else "NONE"))


def first_sets(margins: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Place in ``CELLS`` of the best set by the margins of all causes (``diagnose.set_order``), -1 without any."""
    m = np.where(there, margins, 0.0)
    below = []
    for s in _BY_RANK:
        total = np.zeros(len(m))
        for c in s:
            total = total + m[:, CAUSES.index(c)]
        for i, c in enumerate(CAUSES):
            if c not in s:
                total = total - np.maximum(0.0, m[:, i])
        below.append(np.where(np.isnan(total), np.inf, -total))
    code = np.array([CELLS.index("+".join(s) if s else "NONE") for s in _BY_RANK])
    return np.where(there.any(axis=1), code[np.stack(below, axis=1).argmin(axis=1)], -1)


def predicted(x: np.ndarray, there: np.ndarray, fitted: dict[str, Held], near: Sequence[int], place: Sequence[int]) -> np.ndarray:
    """Place in ``CELLS`` of the set that each of ``METHODS`` names for each row, -1 for none."""
    if len(x) > ROWS:
        return np.concatenate([predicted(x[i:i + ROWS], there[i:i + ROWS], fitted, near, place) for i in range(0, len(x), ROWS)])
    cell, found = _nearest_cell(x[:, near], there[:, near], fitted, len(near))
    margin, has = _full_margins(x[:, place], there[:, place], fitted)
    sets = [np.where(found, cell, -1)]
    for f3 in range(len(FULL_METHODS)):
        own = [SCORES.index((f3, c)) for c in CAUSES]
        sets.append(first_sets(margin[:, own], has[:, own]))
    return np.stack(sets, axis=1)


def _judged(points: Sequence[tuple]) -> np.ndarray:
    """Which methods are judged at a point: a channel that a method does not read is not lost to it."""
    lost = [p[3] or "" for p in points]
    return np.array([[not (c.startswith("C8") and not m.startswith("D4") or c.startswith("C9") and m != "D4-FULL-F3") for m in METHODS] for c in lost])


def _blocks(runs: Runs, points: int, width: int) -> Iterator[Runs]:
    """So many runs at once as their points and masked series leave small."""
    each = points * width + 30 * int(np.prod(runs.series[0].shape[1:]))
    step = max(1, 2 * BLOCK // each)
    for i in range(0, len(runs.run_id), step):
        part = slice(i, i + step)
        yield Runs(runs.condition[part], runs.repetition[part], runs.run_id[part], runs.x[part], runs.there[part], runs.ordinals[part], tuple(a[part] for a in runs.series))


COUNTS = "campaign_id bigint, condition_id string, repetition int, method string, family string, severity double, seed int, lost string, predicted_set string, n bigint"


def noise_scale(x: np.ndarray, there: np.ndarray) -> Held:
    """Sample SD of each feature's present values, and whether there are two."""
    n, _, sd = _spread(x, there) if len(x) else (np.zeros(x.shape[1]),) * 3
    return sd, n > 1


def count_points(codes: np.ndarray, campaign: int, condition: Sequence[str], repetitions: np.ndarray, points: Sequence[tuple], out: dict[str, list]) -> None:
    """Append to ``out`` how often each method names each set (``codes``: run, point, method) for a condition at a point."""
    held, which = np.unique(np.array(condition, object), return_inverse=True)
    alone = np.array([p[0] == "clean" for p in points])
    sizes = (len(held), len(points), len(METHODS), len(CELLS))
    point, method = (a[None] for a in np.indices(sizes[1:3]))
    for repetition in (None, *sorted(set(repetitions.tolist()))):
        rows = np.ones(len(which), bool) if repetition is None else repetitions == repetition
        use = np.flatnonzero(~alone if repetition is None else alone)
        own = codes[rows][:, use]
        spot = np.ravel_multi_index((which[rows][:, None, None], point[:, use], method[:, use], np.maximum(own, 0)), sizes)
        times = np.bincount(spot[own >= 0], minlength=0)
        key = np.flatnonzero(times)
        at, place, by, cell = np.unravel_index(key, sizes)
        columns = {
            "campaign_id": [campaign] * len(key), "condition_id": held[at], "repetition": [repetition] * len(key), "method": [METHODS[i] for i in by],
            **{name: [points[i][j] for i in place] for j, name in enumerate(("family", "severity", "seed", "lost"))},
            "predicted_set": [CELLS[i] for i in cell], "n": times[key].tolist()}
        for name, values in columns.items():
            out[name].extend(values)


def judge_pair(table: pa.Table, known: Mapping[str, tuple], features: Sequence[str], grid: Grid) -> pa.Table:
    """``point_counts`` of one pair's requests."""
    features = list(features)
    near, place = [features.index(f) for f in F2], [features.index(f) for _, f in PAIRS]
    out = {name: [] for name in ("campaign_id", "condition_id", "repetition", "method", "family", "severity", "seed", "lost", "predicted_set", "n")}
    with np.errstate(all="ignore"):
        by_campaign = campaign_runs(table, known, features)
        source = [r for c, runs in by_campaign.items() if fmod(c, 2) == 0 for r in runs]
        if source:
            x, there, repetition = (np.concatenate([getattr(r, k) for r in source]) for k in ("x", "there", "repetition"))
            degree, sets, label = (np.array([known[c][i] for r in source for c in r.condition], t) for i, t in enumerate((int, object, int)))
            folds = {f: np.flatnonzero((degree <= 1) & (repetition != f)) for f in {0, *repetition.tolist()}}
            models = {f: model(x, there, label, sets, train, near, place) for f, train in folds.items() if len(train)}
            noise_sd = noise_scale(x[degree <= 1], there[degree <= 1])
            for campaign, parts in by_campaign.items():
                side = int(fmod(campaign, 2))
                points = grid.points(100 * side)
                judged, named = _judged(points), []
                for runs in (block for part in parts for block in _blocks(part, len(points), len(features))):
                    at, present, has = degraded(runs, grid, 100 * side, noise_sd, features)
                    codes = np.full((len(runs.run_id), len(points), len(METHODS)), -1)
                    fold = runs.repetition if side == 0 else np.zeros(len(runs.run_id), int)
                    for f in models.keys() & set(fold.tolist()):
                        own = fold == f
                        codes[own] = predicted(*(a[own].reshape(-1, len(features)) for a in (at, present)), models[f], near, place).reshape(-1, len(points), len(METHODS))
                    named.append(np.where(has[..., None] & judged, codes, -1))
                condition, repetitions = [c for r in parts for c in r.condition], np.concatenate([r.repetition for r in parts])
                count_points(np.concatenate(named), campaign, condition, repetitions, points, out)
    kinds = {"campaign_id": pa.int64(), "repetition": pa.int32(), "severity": pa.float64(), "seed": pa.int32(), "n": pa.int64()}
    return pa.table({name: pa.array(v, kinds.get(name, pa.string())) for name, v in out.items()})


def point_counts(requests: DataFrame, known: Mapping[str, tuple], features: Sequence[str], grid: Grid) -> DataFrame:
    """How often each method predicts each set for the runs of a condition at every point of the grid, from ``pair_requests``.

    ``known`` maps a condition to its degree, set and labels. Source runs are judged by the models of their own fold, target
    runs by that which leaves nothing out. Rows of the clean point stand once a repetition; the others have none.
    """
    # a pair is some tenths of a second of work and few bytes, so pairs spread by their number
    tasks = max(1, int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return requests.repartition(tasks, "pair_id").groupBy("pair_id").applyInArrow(lambda table: judge_pair(table, known, features, grid), COUNTS)


def large_pairs(requests: DataFrame) -> DataFrame:
    """Pairs of more runs or requests than one task takes."""
    runs = requests.groupBy(pair_of(), *RUN).agg(F.count(F.lit(1)).alias("_n"))
    sizes = runs.groupBy("pair_id").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_runs"))
    return sizes.where((F.col("_n") > MOST_REQUESTS) | (F.col("_runs") > MOST_RUNS)).select("pair_id")
