"""Scales of the cells of a factorial comparison in one pass, and the design audit without the run table."""

import pytest

from tailwatch.operators import csd as C
from tailwatch.operators.design import CONDITIONS


def test_scales_come_from_one_pass_on_both_routes(spark):
    rows = [(0, c["condition_id"], rep, f, None if (i + rep) % 7 == 0 else float((i * 13 + rep * 29 + j * 5) % 17) / 3)
            for i, c in enumerate(CONDITIONS) for rep in range(1, 7) for j, f in enumerate(C.PRIMARY_FEATURES[:2])]
    long = spark.createDataFrame(rows, "campaign_id long, condition_id string, repetition int, feature string, value double")
    key = lambda r: (r.compound, r.feature)
    sd, mad = ({key(r): r.scale for r in df.collect()} for df in (C.pooled_sd(long), C.pooled_mad(long)))
    for hot_rows in (None, 4, 5):
        found = {key(r): r for r in C.pooled_scales(long, hot_rows).collect()}
        assert found.keys() == sd.keys() and sd
        for k, r in found.items():
            assert (r.sd_scale, r.mad_scale) == (pytest.approx(sd[k]), pytest.approx(mad[k]))
    # the only join places conditions in cells
    assert C.pooled_scales(long)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_design_audit_builds_no_run_table(spark, monkeypatch):
    from tailwatch.plans import load
    from tailwatch.plans import tables as V

    monkeypatch.setattr(V, "runs", lambda *_: pytest.fail("the run table was built"))
    assert load()["dq_design"].build(spark, "/root/testdata/sf0.01").count() > 0
