"""Window features from wide rows, filters on computed columns, and counting by a cheaper frame."""

from pyspark.sql import functions as F

from tailwatch.functions.core import round_doubles
from tailwatch.operators import temporal as T
from tailwatch.operators.grouped import HOT_ROWS, hot_groups
from tailwatch.sources import driver_views as V
from tailwatch.sources.spans import expand_spans

KEYS = ["run_id"]


def _series(spark):
    value = lambda i: F.when((F.col("ordinal") + i) % 7 != 3, F.sin(F.col("ordinal") * (i + 1)) + F.length("run_id"))
    rows = spark.range(3).select(F.explode(F.sequence(F.lit(1), F.col("id") * 12 + 1)).alias("ordinal"), F.concat(F.lit("r"), "id").alias("run_id"))
    return T.ordered_series(rows.select("run_id", "ordinal", value(0).alias("a"), value(1).alias("b"), F.lit(1.0).alias("c")), KEYS)


def _rows(df):
    return sorted(map(str, round_doubles(df).collect()))


def test_window_features_equal_the_melted_ones(spark):
    series, metrics = _series(spark), ["a", "b", "c"]
    names = ["run_id", "k", "metric", "n", "early_median", "late_median", "late_minus_early", "normalized_slope"]
    melted = T.melt(series, KEYS, ("ordinal", "rn", "n"), metrics)
    want = [T.fixed_window_features(melted, KEYS, k).withColumn("k", F.lit(k)).select(*names) for k in (3, 10)]
    for hot_rows in (None, 5):
        got = T.window_features(series, KEYS, (3, 10), metrics, hot_rows).select(*names)
        assert _rows(got) == _rows(want[0].unionByName(want[1]))


def test_span_filter_reads_computed_columns(spark):
    events = spark.createDataFrame([(i, None, 1, "view", 1.0, '{"k": 3}') for i in range(3)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    plan = expand_spans(V.requests_from(events), V.RUN)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "get_json_object" in line or "Filter" in line and "% 41" in line]


def test_bound_without_hot_groups_spares_the_count(spark):
    few = spark.range(4).withColumn("run_id", F.lit("r"))
    never = few.withColumn("run_id", F.raise_error(F.lit("counted")).cast("string")).withColumn("seed", F.lit(1))
    assert hot_groups(never, ["run_id", "seed"], HOT_ROWS - 1, few)[1] == 0
    assert hot_groups(few.withColumn("seed", F.lit(1)), ["run_id", "seed"], 3, few)[1] == 1


def test_masks_are_shuffled_once(spark):
    series = _series(spark)
    grid = T.sampled_grid(series, KEYS, (0.75, 0.5), F.array(F.lit(1), F.lit(2)))
    plan = T.order_features(grid, [*KEYS, "seed", "severity"], ["a", "b", "c"], order="ordinal", bound=series)._jdf.queryExecution().executedPlan().toString()
    # one for the positions of the series itself, one for the dealing of runs
    assert plan.count("Exchange ") <= 2
