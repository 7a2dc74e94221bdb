"""The corpus pipeline: STAGES in order, each over all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwatch.llm import bwt_dedup, minhash, mixing, packing, quality_votes
from tailwatch.session import pin, tune


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go."""
    return quality_votes.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles: the document of smallest key stays of each group.

    Rows that repeat a key are documents of their own, and only go if their texts are near one that stays; so are rows
    without a key, which come after all others of their group.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        kept = minhash.near_duplicates(docs).where(F.col("doc_id") == F.col("component")).select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    rows = pin(docs.withColumn("_place", F.monotonically_increasing_id()))
    found = minhash.near_duplicates(rows.select("_place", "text"), "_place").join(rows.select("_place", "doc_id"), "_place")
    first = F.min_by("_place", F.struct(F.col("doc_id").isNull(), "doc_id", "_place")).alias("_place")
    kept = found.groupBy("component").agg(first).select("_place")
    return rows.join(kept, "_place", "left_semi").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: passages of 50 bytes and more that an earlier document has are cut; n_chars follows."""
    cut = bwt_dedup.remove_repeats(docs).withColumn("_text", F.when(F.col("n_removed") > 0, bwt_dedup.kept_text()).otherwise(F.col("kept").cast("string")))
    columns = {c: F.col(f"_row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("_text").cast("long")).otherwise(columns["n_chars"])
    return cut.select(*[columns[c].alias(c) for c in docs.columns])


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: rows are repeated or left out."""
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the token sequences of all rows."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", good_documents),
    ("minhash near-dedup", distinct_documents),
    ("suffix-array dedup", without_repeats),
    ("source mixing", mixed_documents),
    ("packing", packed_sequences),
]

#: Rows in one Arrow batch, as in the single queries.
ARROW_ROWS = "512"
#: The stages fit models, hash and pack; SQL cannot express them. Tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again by the next."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
