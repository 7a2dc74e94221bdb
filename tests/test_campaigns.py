"""Campaigns judged in one task: what the rows give, with one dealing of runs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailwatch.operators import campaigns as CM
from tailwatch.operators import diagnose as G
from tailwatch.operators import learners as L
from tailwatch.operators.design import CONDITIONS

KEYS = ["campaign_id", "fold"]
TIERS = {"A": G.PAIR_FEATURES[:9], "B": G.PAIR_FEATURES[4:]}


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(8)
    rows = []
    for campaign in (0, 1):
        for i, c in enumerate(CONDITIONS):
            for rep in (1, 2, 4):
                for j, f in enumerate(G.PAIR_FEATURES):
                    gone = (i + rep + j) % 11 == 0 or (campaign == 1 and j == 3)
                    value = 0.1 if j == 5 else float(rng.normal() + i * (j % 5) / 3)
                    rows.append((campaign, c["condition_id"], rep, f"c{campaign}-r{rep}-{i}", f, None if gone else value))
    return G.labelled(spark.createDataFrame(rows, "campaign_id long, condition_id string, repetition int, run_id string, feature string, value double")).localCheckpoint()


@pytest.fixture(scope="module")
def vectors(long):
    return G.feature_vectors(long, ["campaign_id"], G.PAIR_FEATURES).localCheckpoint()


def rounded(df, names):
    return sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()), key=str)


def tier_rows(long, tier, protocol):
    """Standardised vectors of a tier by the row route."""
    rows = G.split_folds(long.where(F.col("feature").isin(*TIERS[tier])), protocol)
    scale = G.scaling(rows.where("role = 'train'"), KEYS)
    return G.vectors(G.standardize(rows, scale, KEYS), KEYS, TIERS[tier]).localCheckpoint()


@pytest.mark.parametrize("protocol", ["P1", "P2"])
def test_closest_sets_equal_those_of_rows(long, vectors, protocol):
    found = CM.closest_sets(vectors, G.PAIR_FEATURES, TIERS, ("P1", "P2")).where(F.col("protocol") == protocol).localCheckpoint()
    for tier, members in TIERS.items():
        vecs = tier_rows(long, tier, protocol)
        names = ["run_id", "fold", "truth_set", "predicted_set", "score"]
        of = lambda m: found.where((F.col("tier") == tier) & (F.col("method") == m))  # noqa: E731, B023
        assert rounded(of("M1"), names) == rounded(G.nearest_centroid(vecs, KEYS, len(members)), names)
        assert rounded(of("M0"), [*names, "neighbour_id"]) == rounded(G.nearest_neighbour(vecs, KEYS, len(members)), [*names, "neighbour_id"])


def test_margins_equal_those_of_rows(long, vectors):
    packed = G.train_evidence(long).localCheckpoint()
    rows = G.ranked_sets(G.packed_margins(packed, G.packed_thresholds(packed, KEYS), KEYS), KEYS).where("role = 'test'")
    found = G.with_ranks(CM.evidence_margins(vectors, G.PAIR_FEATURES))
    names = ["run_id", "fold", "method", "q", "role", "degree", "truth_set", "predicted_set", "set_margin", *[c for c in rows.columns if c.startswith("m_")]]
    assert rounded(found, names) == rounded(rows, names)


@pytest.mark.parametrize("loss", ["logistic", "hinge", "descent"])
def test_fits_equal_those_of_one_group(long, vectors, loss):
    members = TIERS["A"]
    narrow = vectors.withColumn("x", F.array(*[F.get("x", F.lit(G.PAIR_FEATURES.index(f))) for f in members]))
    vecs = tier_rows(long, "A", "P1").withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))))
    rows = L.fit(L.cause_targets(vecs.where("role = 'train'")), [*KEYS, "cause"], loss)
    near = lambda df: {(r.campaign_id, r.fold, r.cause): (r.w, r.settled) for r in df.collect()}
    expected, got = near(rows), near(CM.linear_models(narrow, members, loss))
    assert expected and got.keys() == expected.keys()
    for k in expected:
        assert got[k][0] == pytest.approx(expected[k][0], abs=1e-6) and got[k][1] == expected[k][1]
    values = CM.linear_values(narrow, members, loss, {"A": members}).drop("tier", "protocol")
    names = ["run_id", "fold", *[c for c in values.columns if c.startswith("f_")]]
    a, b = rounded(values, names), rounded(L.fitted_values(vecs, KEYS, loss), names)
    assert [r[:2] for r in a] == [r[:2] for r in b] and np.allclose([r[2:] for r in a], [r[2:] for r in b], atol=1e-5)


def test_one_class_gives_a_constant_and_short_folds_are_not_filled_up():
    rng = np.random.default_rng(2)
    rows = [rng.normal(size=(n, 3)) for n in (40, 25)]
    labels = [np.stack([np.where(r[:, 0] + rng.normal(size=len(r)) > 0, 1.0, -1.0), -np.ones(len(r))], axis=1) for r in rows]
    w, settled = CM.fold_fits(rows, labels, "logistic")
    assert settled.all() and w[:, 1].tolist() == [[0.0, 0.0, 0.0, -30.0]] * 2
    for i in range(2):
        assert w[i, 0] == pytest.approx(L.newton_fit(rows[i], labels[i][:, 0], "logistic"), abs=1e-8)
    assert not CM.fold_fits(rows, labels, "logistic", most_steps=1)[1][:, 0].any()


def test_runs_are_dealt_once_by_campaign(vectors):
    """Folds, tiers and protocols multiply rows in the task: nothing is dealt by them."""
    for found in (CM.closest_sets(vectors, G.PAIR_FEATURES, TIERS, ("P1", "P2")), CM.evidence_margins(vectors, G.PAIR_FEATURES),
                  CM.linear_values(vectors, G.PAIR_FEATURES, "hinge", TIERS)):
        dealt = re.findall(r"hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
        assert len(dealt) == 1 and dealt[0].startswith("campaign_id")


def test_large_campaigns_take_the_row_route(spark, monkeypatch):
    """The prediction table is the same whichever route its campaigns take."""
    from tailwatch.plans import diagnosis_queries as D
    from tailwatch.plans import tables as V

    both = []
    for most in (CM.MOST_RUNS, 0):
        monkeypatch.setattr(CM, "MOST_RUNS", most)
        for key in [k for k in V._kept if k[0] in ("closest", "tested", "predictions")]:
            del V._kept[key]
        found = D.predictions(spark, "/root/testdata/sf0.001")
        both.append(rounded(found, sorted(found.columns)))
    assert both[0] == both[1] and both[0]
