"""The pipeline's stages in turn, and the entry file's register."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tailwatch.llm.tokens import encoder
from tailwatch.session import pin

SF = "/root/testdata/sf0.001"


def test_stages_hold_their_contracts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(pin(stage(spark, kept[-1], SF)))
    start, good, distinct, cut, mixed, packed = kept
    assert all(d.columns == start.columns for d in (good, distinct, cut, mixed))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = start.join(labels.where("quality = 1"), "doc_id").select("doc_id").collect()
    left = {r.doc_id for r in good.select("doc_id").collect()}
    assert np.mean([r.doc_id in left for r in clean]) > 0.9
    assert distinct.count() < good.count() and distinct.select("doc_id").distinct().count() == distinct.count()
    assert cut.count() == distinct.count() and cut.agg(F.sum(F.octet_length("text"))).first()[0] < distinct.agg(F.sum(F.octet_length("text"))).first()[0]
    size = lambda d: d.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert abs(size(mixed) / size(cut) - 1) < 0.1
    e = encoder()
    want = sorted(tuple([*e.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in mixed.collect())
    rows = packed.toPandas()
    assert rows.length.sum() == sum(map(len, want)) and rows.groupby("sequence_id").length.sum().max() <= 4096


def test_odd_rows_pass_all_stages(spark):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, None, "en", "a", None)] + [(3, "the cat and the dog of a house " * 5, "en", "a", 1)] * 2
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for start in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            start = pin(stage(spark, start, SF))
        start.count()


def test_repeated_keys_stay_apart(spark):
    """Only near duplicates go: two texts under one key, and texts without a key, are documents of their own."""
    one, two = " ".join(f"one{i}" for i in range(60)), " ".join(f"two{i}" for i in range(60))
    rows = [(1, one, "en", "a", 1), (1, two, "en", "a", 1), (2, one + " more", "en", "a", 1), (None, two, "en", "a", 1), (None, "three " + one[:80], "en", "a", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    kept = corpus_pipeline.distinct_documents(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, one), (1, two), (None, "three " + one[:80])], key=str)


def test_only_cut_characters_go(spark):
    """A document keeps its own replacement signs; characters go that a cut went through, at both ends of it."""
    shared = "ß" * 40
    rows = [(1, "own a" + shared, "en", "a", 1), (2, "own \ufffd sign " + shared + "\u4e2d and \ufffd here", "en", "a", 1), (3, "é中😀" + "x" * 49 + "中é", "en", "a", 1), (4, "ü中😀" + "x" * 49 + "中ü", "en", "a", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, docs, SF).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert got[2] == "own \ufffd sign " + "\u4e2d and \ufffd here"
    assert got[4] == "ü"  # the last letter begins with the byte that é begins with, which is part of the passage


def test_register():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)} and "pipeline" in names
