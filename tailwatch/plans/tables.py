"""Views shared by the queries. The run table is kept for the session, as several queries read it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import runs as R
from ..operators.grouped import forget_sizes
from ..session import pin
from ..sources import driver_views as V
from ..sources.spans import expand_spans

_kept: dict[tuple, DataFrame] = {}


def file_state(spark: SparkSession, sf_dir: str, table: str = "events") -> tuple:
    """What tells one state of a table's files from another: bytes, files and time of the last change of its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    content = files.getContentSummary(path)
    return content.getLength(), content.getFileCount(), files.getFileStatus(path).getModificationTime()


def is_kept(name: str, spark: SparkSession, sf_dir: str) -> bool:
    return (name, spark.sparkContext.applicationId, sf_dir, *file_state(spark, sf_dir)) in _kept


def keep(name: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """Build once per session, folder and state of its events, written to the checkpoint folder."""
    key = (name, spark.sparkContext.applicationId, sf_dir, *file_state(spark, sf_dir))
    if key not in _kept:
        _kept[key] = pin(build())
    return _kept[key]


def release() -> None:
    _kept.clear()
    forget_sizes()


requests, system, runtime, events = V.requests, V.system_metrics, V.runtime_metrics, V.events
sampled_requests = V.sampled_requests


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand_spans(requests(spark, sf_dir), V.RUN)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep("runs", spark, sf_dir, lambda: R.run_metrics(
        requests(spark, sf_dir), system(spark, sf_dir), runtime(spark, sf_dir), spans(spark, sf_dir)))


def request_features(spark: SparkSession, sf_dir: str, features: list[str]) -> DataFrame:
    """Run rows with ``features``, all of them of the requests: of the kept run table, else from the requests alone."""
    if is_kept("runs", spark, sf_dir):
        return runs(spark, sf_dir).select(*V.RUN, *features)
    return keep("request-features-" + ",".join(features), spark, sf_dir, lambda: R.request_aggregates(requests(spark, sf_dir)).select(*V.RUN, *features))
