"""Residuals of features that the requests alone give need no run table."""

from tailwatch.operators import csd as C
from tailwatch.plans import inference_queries as I
from tailwatch.plans import load
from tailwatch.plans import tables as V

SF = "/root/testdata/sf0.001"
COLUMNS = [*C.KEYS, "feature", "repetition", "delta", "scale", "z"]


def test_residuals_without_the_run_table_equal_those_of_it(spark):
    load()
    V.release()
    alone = sorted(map(tuple, I.residuals(spark, SF).select(*COLUMNS).collect()))
    assert not V.is_kept("runs", spark, SF)
    V.release()
    V.runs(spark, SF)
    assert sorted(map(tuple, I.residuals(spark, SF).select(*COLUMNS).collect())) == alone and alone
    V.release()
