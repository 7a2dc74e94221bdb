"""Corpus operators against brute force on small fixtures, with nulls, ties, copies, empty tables and clashing columns."""

import hashlib
import math
import re
import struct
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailwatch.llm import bwt_dedup, kd_shards, language_id, minhash, mixing, packing, pivots, quality_votes, store, token_store, warc_zip
from tailwatch.llm.common import components
from tailwatch.llm.tokens import encoder
from tailwatch.session import checkpoint_dir

SF = "/root/testdata/sf0.001"
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that hold every special case at once."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    same = "the quick brown fox jumps over the lazy dog and then the other fox runs home to sleep for a very long time today"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \t\n ", "en", "a", 5), (4, same, "en", "b", len(same)), (5, same, None, None, None),
            (5, same, None, None, None), (6, same + " indeed", "de", "b", 9), (7, long, "en", "b", len(long)), (8, long[:90_000] + " changed", "en", "c", 1),
            (9, "one", "fr", "c", 3), (10, "One", "fr", "c", 3), (11, "\x00\x1c ~ é É ß 中文 , a.b", "es", "d", 4), (None, "no key at all", "en", "d", 2), (12, same.upper(), "en", "d", 2)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return WORD.findall(text or "")


def repeat_words(w):
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i:i + 8])].append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_quality_measures_match_brute_force(spark, odd, small):
    for docs in (odd, small):
        got = quality_votes.judged(quality_votes.measures(docs, "text")).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
        for r in got:
            w, text = words(r["text"]), r["text"] or ""
            lines = [x for x in text.split("\n") if WORD.search(x)]
            n = repeat_words(w)
            assert r[1:] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w))


def test_quality_model_estimates_planted_rules(spark):
    """Votes drawn from known accuracies: the estimate finds them, and which rule is worthless."""
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.8
    right = [0.95, 0.9, 0.9, 0.85, 0.5]
    votes = [[int((t if rng.random() < a else not t)) * 2 - 1 if rng.random() < 0.9 else 0 for a in right] for t in truth]
    df = spark.createDataFrame([(v,) for v in votes], "votes array<int>").groupBy("votes").agg(F.count("*").alias("_n"))
    model = quality_votes.fit(df, rules=5)
    found = [t[1][2] / (t[1][0] + t[1][2]) for t in model["tables"]]
    assert all(abs(f - a) < 0.06 for f, a in zip(found, right))
    out = spark.createDataFrame([(v, bool(t)) for v, t in zip(votes, truth)], "votes array<int>, good boolean").select((quality_votes.posterior(model) >= 0.5).alias("p"), "good").collect()
    assert np.mean([r.p == r.good for r in out]) > 0.95


def test_quality_keeps_rows_whole(spark, small, odd, empty):
    clash = small.withColumn("_row", F.lit(1)).withColumn("votes", F.lit("x")).withColumn("n_words", F.lit(-1))
    kept = quality_votes.keep_good(clash)
    assert kept.columns == clash.columns
    same = quality_votes.verdicts(small).where("kept").select("doc_id").collect()
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in same)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in quality_votes.verdicts(small).collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept == (labels[r.doc_id] == 1) for r in rows]) > 0.9
    assert quality_votes.verdicts(odd).count() == odd.count()
    assert quality_votes.keep_good(empty).count() == 0 and quality_votes.verdicts(empty).count() == 0


def brute_targets(sizes, weights, most=3.0):
    """Clamp and share again until nothing is above."""
    total, clamped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in clamped)
        free = {s: weights[s] for s in sizes if s not in clamped}
        share = {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = {s for s, t in share.items() if t > most * sizes[s]}
        if not over:
            return {**{s: most * sizes[s] for s in clamped}, **share}
        clamped |= over


def test_mixing(spark, small, odd, empty):
    skewed = small.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src_hot").when(F.col("doc_id") == 7, "tiny").otherwise(F.col("source")))
    for docs in (skewed, odd):
        rows, plan = mixing.mixture(docs)
        got = rows.join(plan, "_s").select("_id", "_s", "_size", "_source_size", "_target", mixing.copies().alias("n")).collect()
        assert len(got) == docs.count()
        size = defaultdict(int)
        for r in docs.collect():
            size["w" if r.source is None else "v" + r.source] += len(words(r.text))
        weights = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(sorted(size))}
        want = brute_targets(size, weights)
        taken, largest = defaultdict(int), defaultdict(int)
        for r in got:
            assert math.isclose(r["_target"], want[r["_s"]], rel_tol=1e-9, abs_tol=1e-6) and r["_source_size"] == size[r["_s"]] and 0 <= r["n"] <= 3
            taken[r["_s"]] += r["_size"] * r["n"]
            largest[r["_s"]] = max(largest[r["_s"]], r["_size"])
        assert all(abs(taken[s] - want[s]) <= largest[s] for s in size)
        again = {(r["_id"], r["n"]) for r in mixing.mixture(docs.repartition(7))[0].join(plan, "_s").select("_id", mixing.copies().alias("n")).collect()}
        assert again == {(r["_id"], r["n"]) for r in got}
        mixed = mixing.mix(docs.withColumn("_s", F.lit("clash")))
        assert mixed.columns == [*docs.columns, "_s"] and mixed.count() == sum(r["n"] for r in got)
    assert mixing.mix(empty).count() == 0


def test_kd_shards(spark, small, odd, empty):
    placed = kd_shards.with_slots(kd_shards.kd_shards(small, shards=7)).toPandas()
    total = placed.groupby("_part")["_size"].sum()
    assert len(placed) == small.count() and len(total) == 7
    assert (total - total.mean()).abs().max() <= placed["_size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in placed.groupby("_part")["_slot"])
    copies = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    counts = kd_shards.kd_shards(copies, shards=5).groupBy("_part").count().toPandas()["count"]
    assert len(counts) == 5 and counts.max() - counts.min() <= 2  # a group that outweighs a shard is split evenly
    alone = kd_shards.with_slots(kd_shards.kd_shards(copies.withColumn("doc_id", F.lit(None).cast("long")), shards=5)).toPandas()
    counts = alone.groupby("_part").size()
    assert len(alone) == 400 and len(counts) == 5 and counts.max() - counts.min() <= 3  # without keys as well
    assert all(sorted(g) == list(range(len(g))) for _, g in alone.groupby("_part")["_slot"])
    assert kd_shards.kd_shards(odd, target_bytes=1 << 16).count() == odd.count()
    assert kd_shards.kd_shards(empty, shards=3).count() == 0


def test_kd_tree_splits_the_widest_dimension(spark):
    """Against sums over all pairs of bytes: a category that hardly varies does not win over a number that does."""
    rng = np.random.default_rng(7)
    n = 400
    rows = [(i, "x" * int(rng.integers(0, 60)), "rare" if i % 50 == 0 else "common", "en", int(2 ** rng.uniform(0, 20))) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    measured = kd_shards.measured(docs, "doc_id", "text", ["source", "lang"], ["n_chars"]).withColumns({"_part": F.lit(0), "_leaves": F.lit(2)})
    ranges = kd_shards._ranges(measured, 2, 3)
    got = kd_shards._widest(measured, 2, 3, ranges).first()
    size = np.array([len(r[1]) + 16 for r in rows], float)
    value = {"source": np.array([r[2] == "rare" for r in rows], float), "lang": np.zeros(n), "n_chars": np.log2(np.array([r[4] for r in rows], float) + 2)}
    value["n_chars"] /= np.ptp(value["n_chars"])
    weight = size[:, None] * size[None, :]
    spread = {k: math.sqrt((weight * (v[:, None] - v[None, :]) ** 2).sum() / weight.sum()) for k, v in value.items()}
    assert spread["n_chars"] > spread["source"] > spread["lang"] == 0
    assert got["_dim"] == 2 and got["_bytes"] == size.sum()
    mixed = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    measured = kd_shards.measured(mixed, "doc_id", "text", ["source", "lang"], ["n_chars"]).withColumns({"_part": F.lit(0), "_leaves": F.lit(2)})
    assert kd_shards._widest(measured, 2, 3, ranges).first()["_dim"] == 0


def test_warc_packages(spark, tmp_path):
    pages = spark.createDataFrame([(3, "http://a", "<p>x</p>"), (1, "http://b", "<p>x</p>"), (2, None, None), (4, "", ""), (5, "u\r\nX: y", "é" * 300_000), (None, "n", "<p>x</p>"), (1, "http://b", "<p>x</p>")],
                                  "page_id long, url string, html string")
    packages = warc_zip.write_packages(pages.coalesce(2), f"file:{tmp_path}/p")
    got = {(r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_zip.read_packages(packages).collect()}
    d = lambda t: warc_zip.digest(t.encode())
    x = (8, d("<p>x</p>"))
    assert got == {(1, *x, "response", None), (3, *x, "revisit", 1), (None, *x, "response", None), (2, 0, d(""), "response", None), (4, 0, d(""), "revisit", 2), (5, 600_000, d("é" * 300_000), "response", None)}
    texts = {r.key: r.payload for r in warc_zip.read_packages(packages, ["key", "payload"]).collect()}
    assert bytes(texts[5]).decode() == "é" * 300_000 and texts[3] is None
    none = warc_zip.write_packages(pages.where("false"), f"file:{tmp_path}/none")
    assert warc_zip.read_packages(none).count() == 0


def test_zip64_directory(tmp_path, monkeypatch):
    """A package whose sizes, places and counts all stand in ZIP64 fields, after leading bytes of a first member."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name in ("a/first.bin", warc_zip.DATA, warc_zip.INDEX):
            z.writestr(name, name.encode() * 50)
    file, size = store.open_ranges(str(path))
    members = warc_zip.directory(file, size)
    assert list(members) == ["a/first.bin", warc_zip.DATA, warc_zip.INDEX]
    for m in members.values():
        assert warc_zip._at(file, warc_zip.data_start(file, m), m.size) == m.name.encode() * 50
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("c", b"0" * 100)
    file, size = store.open_ranges(str(tmp_path / "c.zip"))
    with pytest.raises(ValueError, match="compressed"):
        warc_zip.data_start(file, warc_zip.directory(file, size)["c"])


def test_chunk_encoding_equals_whole_texts():
    e = encoder()
    texts = ["", None, " a\x1c!!\x1c b́ c", "Don't we'LL. stop... x,y 'S 's. it's. #abc!!  x ΑΣ ΣΑΣ. İ", "<|endoftext|> a<|endoftext|>b", "a​. é. ́ x ¼ ½. ǅ", "Ünïcödé, wörds; ﬁn. K", "x\x85y z", "\x00 \x01", "word," * 9]
    bounds, ids = e.encode(pa.array(texts), 2)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_store_round_trip(spark, odd, small, empty, tmp_path, encoding):
    e = encoder()
    for i, docs in enumerate((odd, small, empty)):
        path = f"{tmp_path}/{encoding}{i}"
        token_store.write_tokens(docs.withColumn("start", F.lit("clash")).repartition(3), path, encoding=encoding)
        rows = token_store.with_crc(token_store.read_tokens(spark, path)).collect()
        texts = defaultdict(list)
        for r in docs.collect():
            texts[r.doc_id].append(np.array([*e.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4"))
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            ids = texts[r.key].pop()
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
        assert len(rows) == docs.count() and [r.key for r in sorted(rows, key=lambda r: r.start)] == sorted((r.key for r in rows), key=lambda k: (k is not None, k or 0))


@pytest.mark.parametrize("limits", [{}, {"max_tokens": 100, "max_segments": 3, "max_loss": 70, "least_piece": 5}])
def test_packing_limits_and_round_trip(spark, odd, small, empty, limits):
    most = {"max_tokens": 4096, "max_segments": 512, "max_loss": 4096} | limits
    e = encoder()
    for docs in (small, odd):
        docs = docs.withColumn("bearing", F.when(F.col("doc_id") % 2 == 0, F.length("text") / 8).cast("long"))
        got = packing.pack_documents(docs.coalesce(2), loss="bearing", **limits).toPandas()
        for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
            assert g.length.sum() <= most["max_tokens"] and len(g) <= most["max_segments"] and g.loss_tokens.sum() <= most["max_loss"]
            assert (g.offset.to_numpy() == g.length.cumsum().to_numpy() - g.length.to_numpy()).all()
        want = sorted(np.array([*e.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in docs.collect() if r.doc_id != 5)
        rows = got[got.doc_id != 5].sort_values("start").groupby("doc_id", dropna=False)
        assert sorted(b"".join(g.ids) for _, g in rows) == want
        for _, g in rows:
            assert (g.start.to_numpy() == g.length.cumsum().to_numpy() - g.length.to_numpy()).all() and g.length.sum() == g.doc_tokens.iloc[0]
        assert got[got.doc_id == 5].length.sum() == got[got.doc_id == 5].doc_tokens.iloc[0] * docs.where("doc_id = 5").count()
        lost = {r.doc_id: r.bearing for r in docs.collect()}
        for k, g in got[got.doc_id != 5].groupby("doc_id"):
            n = g.doc_tokens.iloc[0]
            assert g.loss_tokens.sum() == (n if lost[k] is None else min(n, lost[k]))
    assert packing.pack_documents(empty).count() == 0


def brute_components(docs, width, percent=80):
    sets = {}
    for r in docs.collect():
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(r.text)]
        sets[r.doc_id] = set() if not w else {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if i is not None and sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            m = len(sets[a] & sets[b])
            if 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_match_brute_force(spark, small, odd, empty, width):
    base = [f"word{i}" for i in range(200)]
    chain = []
    for k in range(30):  # each near the last, the ends far apart
        base = base.copy()
        base[(k * 37) % 200] = f"new{k}"
        chain.append((1000 + k, " ".join(base)))
    hot = [(2000 + k, "a passage that very many texts hold between their own words " * 2 + " ".join(f"own{k}_{j}" for j in range(k % 40))) for k in range(80)]
    made = spark.createDataFrame(chain + hot, "doc_id long, text string")
    for docs in (small.select("doc_id", "text"), made, odd.select("doc_id", "text")):
        got = minhash.near_duplicates(docs.withColumn("rep", F.lit(1)), width=width).collect()
        want = brute_components(docs, width)
        assert len(got) == docs.count()
        assert all((r.n_shingles, r.component) == want[r.doc_id] for r in got)
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (203, 201), (203, 204)]
    nodes = spark.range(300)
    got = {r.id: r.component for r in components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 if i <= 50 else 100 if 100 <= i < 160 else 200 if i in (200, 201, 203, 204) else i for i in range(300)}
    assert got == want


def test_language_id(spark, small, odd, empty):
    docs = small.withColumn("held", language_id.held_out(F.col("doc_id")))
    model = language_id.fit(docs.where("not held"))
    rows = language_id.classify(docs.select("doc_id", "lang", "held", "text"), model).where("held and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9
    assert all((r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)) for r in docs.select("doc_id", "held").collect())
    got = {r.doc_id: r for r in language_id.classify(odd.select("doc_id", "text"), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.classify(odd.select("doc_id", "text"), {}).collect()} == {"und"}
    assert language_id.fit(empty) == {} and language_id.classify(empty.select("doc_id", "text"), model).count() == 0


def test_pivot_index_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in range(3):
        for _ in range(60):
            centre = rng.normal(size=24)
            for _ in range(rng.integers(1, 5)):
                v = centre + rng.normal(size=24) * np.linalg.norm(centre) / math.sqrt(24) * rng.uniform(0.05, 0.45)
                rows.append((n, v.astype("float32").tolist(), label))
                n += 1
    hot = rng.normal(size=24)
    for k in range(120):
        rows.append((n, (hot if k % 2 else hot + rng.normal(size=24) * 0.1).astype("float32").tolist(), 1))
        n += 1
    usable = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] * 24, 1), (n + 3, [1.0] * 24, None), (n + 4, [], 1), (n + 5, [None] + [1.0] * 23, 1), (n + 6, [1e30] * 24, 2), (n + 7, [2e30] * 24, 2), (n + 8, [1.0, 2.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("clash"))
    got = {r.vec_id: r for r in pivots.near_vectors(df).collect()}
    assert len(got) == len(rows)
    v = np.array([r[1] for r in rows[:usable]])
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r[2] for r in rows[:usable]])
    close = (v @ v.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    links = close.sum(1)
    assert sum(got[i].n_links for i in range(usable)) >= 0.9 * links.sum() and all(got[i].n_links <= links[i] for i in range(usable))
    assert all(got[i].component == i and got[i].n_links == 0 for i in (n, n + 1, n + 2, n + 3, n + 4, n + 5, n + 8))
    assert got[n + 7].component == n + 6 and got[n + 7].n_links == 1
    assert pivots.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("share", [1 / 3, 0.6])
def test_pivot_index_in_one_dense_group(spark, share):
    """Near, not equal, vectors that hold much of the table: their links are found all the same."""
    rng = np.random.default_rng(11)
    n, d = 1500, 64
    v = rng.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1)[:, None]
    dense = rng.permutation(n)[:int(n * share)]
    v[dense] = v[dense[0]] * math.sqrt(0.95) + v[dense] * math.sqrt(0.05)
    v = v.astype("float32")
    got = {r.vec_id: r.n_links for r in pivots.near_vectors(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")).collect()}
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    links = (unit @ unit.T >= 0.93).sum(1) - 1
    found = sum(got.values()) / links.sum()
    print(f"share {share:.2f}: recall {found:.3f} of {links.sum()}")
    assert found >= 0.9 and all(got[i] <= links[i] for i in range(n))


def brute_repeats(docs):
    rows = docs.collect()
    big = 1 << 62
    first = {}
    data = [((r.doc_id if r.doc_id is not None else big), (r.text or "").encode(), r.doc_id) for r in rows]
    for k, b, _ in data:
        for j in range(len(b) - 49):
            s = b[j:j + 50]
            first[s] = min(first.get(s, big), k)
    out = []
    for k, b, name in data:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first[b[j:j + 50]] < k:
                gone[j:j + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((name, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_repeats_match_brute_force(spark, small, odd, empty):
    passage = "x" * 49 + "A passage that stands in several texts, and starts at different places of them."
    planted = [(k, "ab" * k + passage[k % 7:] + f" tail {k}" * (k % 3)) for k in range(40)] + [(50, "z" * 500), (51, "z" * 300), (52, "\x00" * 120), (53, "\x00" * 60), (54, passage), (55, "y" * 49), (56, "y" * 49)]
    made = spark.createDataFrame(planted, "doc_id long, text string")
    for docs in (small.select("doc_id", "text"), made, odd):
        found = bwt_dedup.remove_repeats(docs.withColumn("kept", F.lit("clash")).repartition(5))
        got = sorted(((r[0], *r[1:4], hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found.select("_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()), key=str)
        assert got == brute_repeats(docs)
    assert bwt_dedup.remove_repeats(empty).count() == 0


def test_hot_anchors_are_dealt_by_content(spark, small, odd):
    """An anchor that many documents have, each with its own text around it: same result, and no bucket that holds it all."""
    rng = np.random.default_rng(4)
    own = lambda: "".join(map(chr, rng.integers(97, 123, 90)))
    passage = "A passage that a great many texts hold, each between words that no other text has."
    hot = spark.createDataFrame([(k, own() + passage + own()) for k in range(300)] + [(300, passage), (None, own() + passage)], "doc_id long, text string")
    for docs in (hot, small.select("doc_id", "text"), odd):
        found = bwt_dedup.remove_repeats(docs.repartition(5), hot_windows=2)
        got = sorted(((r[0], *r[1:4], hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found.select("_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()), key=str)
        assert got == brute_repeats(docs)
    rows = pa.RecordBatch.from_pydict({"shard": [0] * 300, "key": list(range(300)), "text": [own() + passage + own() for _ in range(300)]})
    folder = f"{checkpoint_dir(spark)}/hot-anchors"
    shared = list(bwt_dedup._shared(2)(bwt_dedup._lists(1)(iter([rows]))))
    spark.createDataFrame([(r["shard"], r["hashes"], r["hot"]) for b in shared for r in b.to_pylist()], "shard long, hashes binary, hot binary").write.partitionBy("shard").parquet(folder)
    sizes = defaultdict(int)
    for b in bwt_dedup._strings(8, folder)(iter([rows])):
        if b["bucket"][0].as_py() >= 8:  # the few anchors that only two texts have stay below
            sizes[b["bucket"][0].as_py()] += len(b["names"][0].as_py()) // 16
    assert len(sizes) == 8 * bwt_dedup.PIECE_BUCKETS and max(sizes.values()) < 2 * sum(sizes.values()) / len(sizes)


def test_merge_keeps_shards_and_ties_apart():
    """Interleaving by column equals grouping by the strings themselves."""
    rng = np.random.default_rng(2)
    strings = rng.integers(97, 99, (400, bwt_dedup.WIDTH)).astype(np.uint8)
    strings[200:] = strings[:200]
    strings[300:, 60:] = 99
    ranges = np.stack((rng.integers(0, 20, 400), rng.integers(60, 81, 400)), 1).astype(np.uint8)
    keys = rng.permutation(400).astype(np.int64)
    got = bwt_dedup.merged_owners(strings, ranges, keys)
    for c in range(bwt_dedup.STARTS):
        least = defaultdict(lambda: bwt_dedup.LAST)
        ok = [(a <= c) and (b >= c + 50) for a, b in ranges]
        for s, k, v in zip(strings[:, c:c + 50], keys, ok):
            if v:
                least[s.tobytes()] = min(least[s.tobytes()], k)
        assert [int(x) for x in got[:, c]] == [int(least[s.tobytes()]) if v else int(bwt_dedup.LAST) for s, v in zip(strings[:, c:c + 50], ok)]


def test_checkpoint_folder_is_the_sessions(spark):
    assert checkpoint_dir(spark)
    assert struct.calcsize("<I") == 4
