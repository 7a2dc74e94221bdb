"""Token ids of documents as Parquet list columns, in ascending key order, for selective reads.

Each file holds one range of keys in order: key, part, start (ids before it in its part), n_tokens and the ids as a list
of 32-bit integers, with dictionary or delta encoding, row groups and pages of set sizes, and the page indexes that
Parquet writes by default. Metadata reads touch no id page; a key range reads the pages that hold it.

Defined results: null text is empty and gets the end id alone; a null key sorts first; rows of one key are ordered by
text, equal rows stand beside each other; an empty table writes no row. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_offsets
from .tokens import encoder, gathered, vocabulary

END_ID = 2
#: Ids in one output batch of a task.
BATCH_IDS = 4_000_000


def encoded(docs: DataFrame, key: str, text: str, vocabulary_path: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """key, part, start, n_tokens, ids in ascending key order; part numbers the sorted ranges, start counts within one."""
    path = vocabulary_path or vocabulary()
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange(F.asc("key")).sortWithinPartitions("key", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in gathered(batches, 1):
            bounds, ids = encode_.encode(batch.column(1), end_id)
            for lo, hi in _slices(bounds, BATCH_IDS):
                own = bounds[lo:hi + 1] - bounds[lo]
                lists = pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(ids[bounds[lo]:bounds[hi]].view("<i4")))
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(np.full(n, part, np.int32)), pa.array(before + own[:-1]), pa.array(np.diff(own)), lists],
                    ["key", "part", "start", "n_tokens", "ids"])
                before += int(own[-1])

    return rows.mapInArrow(encode, f"key {kind.simpleString()}, part int, start long, n_tokens long, ids array<int>")


def _slices(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` ids, or a single row."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def write_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", encoding: str = "dictionary",
                 row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, **options) -> None:
    """Write the store. ``encoding`` of the ids: dictionary, or delta (binary packed)."""
    (encoded(docs, key, text, **options).write
     .option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
     .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("compression", "zstd").parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """key, start (ids of all rows before it), n_tokens, ids. One row per part is summed for the starts."""
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("amount"))
    offsets = F.broadcast(running_offsets(parts, "part", "amount", "_offset"))
    return rows.join(offsets, "part").select("key", (F.col("start") + F.col("_offset")).alias("start"), "n_tokens", "ids")


def with_crc(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """Replaces the id lists by ids_crc32, of the ids as little-endian unsigned 32-bit integers."""
    rest = [c for c in rows.columns if c != ids]

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(rest))
            bounds, values = np.asarray(lists.offsets), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crcs, pa.int64())], [*rest, "ids_crc32"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.select(*rest).dtypes)
    return rows.select(*rest, ids).mapInArrow(crc, f"{fields}, ids_crc32 long")
