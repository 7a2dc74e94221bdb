"""Features held as arrays: the same scores as from rows, and no shuffle of rows that folds have multiplied."""

import re

import pytest
from pyspark.sql import functions as F

from tailwatch.operators import diagnose as G
from tailwatch.operators import features as FT
from tailwatch.operators.design import CONDITIONS

KEYS = ["campaign_id", "fold"]


@pytest.fixture(scope="module")
def long(spark):
    rows = []
    for campaign in (0, 1):
        for i, c in enumerate(CONDITIONS):
            for rep in (1, 2, 4):
                for j, f in enumerate(G.PAIR_FEATURES):
                    value = (campaign * 7 + i * 31 + rep * 17 + j * j * 13 + i * j * 5) % 23 / 7.0
                    gone = (i + rep + j) % 11 == 0 or (campaign == 1 and j == 3)
                    rows.append((campaign, c["condition_id"], rep, f"c{campaign}-r{rep}-{i}", f, None if gone else 4.0 if j == 5 else value))
    return G.labelled(spark.createDataFrame(rows, "campaign_id long, condition_id string, repetition int, run_id string, feature string, value double")).localCheckpoint()


def test_vector_evidence_equals_row_evidence(spark, long):
    registry = FT.evidence_registry(spark)
    split = G.split_folds(long)
    meta = G.feature_meta(split.where("role = 'train'"), KEYS, registry.select("cause", "feature").distinct())
    rows = G.evidence(G.normalized_groups(G.group_scores(G.directional_z(split, meta, KEYS), KEYS, registry), KEYS))
    names = ["run_id", "fold", "role", "method", "cause", "label", *"SMTX", *[f"{g}_norm" for g in G.GROUPS], "E"]
    rounded = lambda df: {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()}
    expected, found = rounded(rows), rounded(G.unpacked(G.train_evidence(long)))
    assert expected and found == expected


def test_packed_margins_equal_row_margins(spark, long):
    packed = G.train_evidence(long).localCheckpoint()
    names = ["run_id", "fold", "role", "method", "cause", "q", "tau", "margin"]
    rounded = lambda df: {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()}
    expected = rounded(G.with_margins(G.unpacked(packed), KEYS, (0.9, 0.95)))
    assert rounded(G.packed_margins(packed, G.packed_thresholds(packed, KEYS, (0.9, 0.95)), KEYS)) == expected and expected


def test_folds_multiply_rows_after_the_shuffle(spark, long):
    """The statistics of the folds need the runs' rows dealt once; nothing is dealt by fold."""
    wanted = FT.evidence_registry(spark).select("cause", "feature").distinct()
    found = G.fold_meta(long, KEYS, wanted)
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
    assert dealt and not any("fold" in keys for keys in dealt)
    split = G.split_folds(long).where("role = 'train'")
    both = [{tuple(r) for r in df.select("campaign_id", "fold", "cause", "feature", "dir", F.round("mu0", 9), F.round("sigma", 9)).collect()} for df in (found, G.feature_meta(split, KEYS, wanted))]
    assert both[0] == both[1]


def test_scales_and_vectors_equal_those_of_rows(spark, long):
    split = G.split_folds(long)
    train = split.where("role = 'train'")
    filled = train.join(train.groupBy(*KEYS, "feature").agg(F.median("value").alias("fill")), [*KEYS, "feature"]).withColumn("_x", F.coalesce("value", "fill"))
    rounded = lambda df: {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()}
    for sample in (False, True):
        sd = (F.stddev_samp if sample else F.stddev_pop)("_x")
        plain = filled.groupBy(*KEYS, "feature").agg(F.first("fill"), F.avg("_x"), F.when(F.coalesce(sd, F.lit(0.0)) > 1e-12, sd).otherwise(1.0))
        scale = G.fold_scaling(long, sample=sample)
        assert rounded(scale.select(*KEYS, "feature", "fill", "mu", "sd")) == rounded(plain)
    scale = G.scaling(train, KEYS)
    rows = G.standardize(split, scale, KEYS)
    names = ["run_id", "fold", "role", "feature", "z"]
    assert rounded(G.standard_folds(long, scale).select(*names)) == rounded(rows.select(*names))
    flat = lambda df: rounded(df.select("run_id", "fold", "role", F.posexplode("x")))
    features = G.PAIR_FEATURES[:6]
    assert flat(G.standard_vectors(long.where(F.col("feature").isin(*features)), scale, features)) == flat(G.vectors(rows, ["fold"], features))


def test_plain_vector_evidence_equals_row_evidence(spark, long):
    registry = FT.plain_registry(spark)
    split = G.split_folds(long)
    meta = G.feature_meta(split.where("role = 'train'"), KEYS, registry.select("cause", "feature"))
    z = G.directional_z(split, meta, KEYS).join(registry, ["cause", "feature"])
    of = lambda g, e: F.avg(F.when(F.col("grp") == g, e))
    names = ["run_id", "fold", "role", "cause", "label"]
    rows = z.groupBy(*names).agg(*[of(g, F.col("z")).alias(g) for g in "SMT"], of("M", F.greatest(F.lit(0.0), -F.col("z"))).alias("X"))
    rounded = lambda df: {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*names, *"SMTX").collect()}
    assert rounded(G.plain_evidence(long)) == rounded(rows)
