"""Registered queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, tune
from . import bwt_dedup, importance, kd_shards, language_id, minhash, mixing, oracle, packing, pivots, quality_votes, token_store, turn_repair, url_models, warc_zip
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Rows in one Arrow batch: whole texts may be long, and a batch has to fit a Python worker.
ARROW_ROWS = "512"


def query(fn):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        return fn(spark, sf_dir)

    build.__name__, build.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = build
    return fn


@query
def op1_quality_rules(spark, sf_dir):
    """Rule votes, their estimated reliability, and the verdict on every document."""
    return quality_votes.verdicts(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query
def op2_source_mixing(spark, sf_dir):
    """How many words of every document the mix takes."""
    rows, per_source = mixing.mixture(read(spark, sf_dir, "documents"))
    return rows.join(mixing.sized_broadcast(per_source), "_s").select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * mixing.copies()).alias("taken"))


@query
def op3_kd_sharding(spark, sf_dir):
    """Every document's shard and place in it; shards have near equal bytes."""
    placed = kd_shards.with_slots(kd_shards.kd_shards(read(spark, sf_dir, "documents"), shards=40))
    return placed.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                         F.col("_part").alias("shard"), F.col("_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_warc_packages(spark, sf_dir):
    """Every page's record, written into ZIP packages and read back by ranges."""
    packages = warc_zip.write_packages(read(spark, sf_dir, "pages"), f"{checkpoint_dir(spark)}/packages-{uuid.uuid4().hex}")
    return warc_zip.read_packages(packages, ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]).withColumnRenamed("key", "page_id")


#: Base32 of the 160 bits of a SHA-1: 32 digits of five bits.
SQL["op4_warc_packages"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(unhex(sha1(coalesce(html, ''))) AS BIT)::VARCHAR AS b FROM pages),
f AS (SELECT b, min(page_id) AS first FROM p GROUP BY b)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(b, 5 * CAST(i AS INT) + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * CAST(i AS INT) + 2, 1) AS INT)
      + 4 * CAST(substr(b, 5 * CAST(i AS INT) + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * CAST(i AS INT) + 4, 1) AS INT)
      + CAST(substr(b, 5 * CAST(i AS INT) + 5, 1) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p JOIN f USING (b)"""


@query
def op5_packing(spark, sf_dir):
    """Every piece of every document in its sequence."""
    return packing.pack_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op6_minhash_near_dedup(spark, sf_dir):
    """Every document's near-duplicate component, over four-word shingles."""
    found = minhash.near_duplicates(read(spark, sf_dir, "documents"), width=4)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


@query
def op7_language_id(spark, sf_dir):
    """Language of every document; held-out documents teach nothing."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    return language_id.classify(docs.select("doc_id", "held_out", "text"), language_id.fit(docs.where("not held_out")))


@query
def op8_pivot_near_dedup(spark, sf_dir):
    """Every vector's links and component among near vectors of its label."""
    found = pivots.near_vectors(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


@query
def op9_token_store(spark, sf_dir):
    """Token ids of every document, written in key order and read back."""
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_tokens(read(spark, sf_dir, "documents"), path)
    return token_store.with_crc(token_store.read_tokens(spark, path)).withColumnRenamed("key", "doc_id")


@query
def op10_bwt_repeats(spark, sf_dir):
    """What every document loses to strings of earlier documents."""
    found = bwt_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("_row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_turn_repair(spark, sf_dir):
    """Faults of every damaged conversation, its cheapest edits, and the hash of what they leave."""
    rows = read(spark, sf_dir, "conversations")
    found = turn_repair.digests(turn_repair.damaged(rows), rows.select(F.col("conv_id").alias("conv")))
    return found.withColumnRenamed("conv", "conv_id")


@query
def op12_importance_resampling(spark, sf_dir):
    """Every document's weight towards the benchmark texts, and the rank of those that are drawn."""
    found = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_url_filter(spark, sf_dir):
    """Every page's address, the rule that decides it, and the verdict of the rule or of the models."""
    return url_models.judge(read(spark, sf_dir, "pages"))


SQL["op11_turn_repair"] = oracle.TURN_REPAIR
SQL["op12_importance_resampling"] = oracle.IMPORTANCE
SQL["op13_url_filter"] = oracle.url_filter(url_models.RULES, url_models.ORDER, url_models.LEAST, url_models.FLOOR, url_models.STEPS, url_models.MOST_STEPS)

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Every pair that shares a shingle is counted and judged; labels then spread along the links until none is smaller.
SQL["op6_minhash_near_dedup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM m JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * m >= 80 * (p.n + q.n - m)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id"""

#: Every pair of vectors of a label.
SQL["op8_pivot_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id)
SELECT d.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, d.vec_id = c.component_id AS kept FROM embeddings d
LEFT JOIN (SELECT x, count(*) AS n FROM e GROUP BY x) l ON l.x = d.vec_id JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY id) c ON c.id = d.vec_id"""

#: Every string of 50 bytes, in hexadecimal, with the smallest document that has it; then runs, and what lies between.
SQL["op10_bwt_repeats"] = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM p GROUP BY s),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM p JOIN f USING (s) WHERE first < doc_id),
t AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
u AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM t),
k AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM u JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
