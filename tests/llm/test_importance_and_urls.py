"""Importance resampling and the URL filter against brute force, and with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tailwatch.llm import importance, queries, url_models
from tailwatch.llm.common import joined_by_share

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_words(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets(text):
    w = text_words(text)
    return Counter(zlib.crc32(" ".join(w[i:i + r]).encode()) % 10_000 for r in (1, 2, 3) for i in range(len(w) - r + 1))


def resampled(docs, target):
    """{place in docs: (n_features, weight, score, rank)}; the rank of equal rows is left to them."""
    own = [buckets(t) for _, t in docs]
    s, t = sum(own, Counter()), sum((buckets(x) for x in target), Counter())
    ns, nt = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in range(10_000)}
    rows = []
    for (key, text), counts in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"42:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain[b] for b, n in counts.items())
        rows.append((key, counts.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(text_words(text))))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = defaultdict(list)
    for i, r in enumerate(fit[:len(fit) * 5 // 100], 1):
        ranks[r].append(i)
    return sorted(((*r[:4], ranks[r].pop(0) if ranks[r] else None) for r in rows), key=str)


ODD = [None, "", " .,- ", "One", "one two", "É ß 中文 x1-y2", "a" * 5000 + " b " * 40, " ".join(f"w{i}" for i in range(30_000)), "the cat " * 300_000]


def test_resampling_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(200)]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "same words here " * 9)] * 30 + [(5, docs[5][1])] * 3
    target = [" ".join(rng.choices(vocabulary[:20], k=50)) for _ in range(10)] + [None, ""]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, weight string, rank int").repartition(5)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string")).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled(docs, target)


@pytest.mark.parametrize("docs,target", [([], ["a b"]), ([(1, "a b c " * 20)] * 25, [])])
def test_resampling_of_nothing(spark, docs, target):
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == resampled(docs, target)


def test_planes_sum_exactly():
    rng = np.random.default_rng(1)
    gain = rng.integers(-9000, 9000, 10_000)
    counts = rng.poisson(0.2, (70, 10_000)).astype(np.uint32)
    counts[3, 7], counts[5] = 70_000, 0
    assert (importance.sliced_weights(counts, *importance.gain_planes(gain)) == counts.astype(np.int64) @ gain).all()
    assert (importance.sliced_weights(counts, *importance.gain_planes(np.zeros(10_000, np.int64))) == 0).all()


def test_pieces_change_nothing(monkeypatch):
    text = " ".join(f"w{i % 37}{'z' * (i % 80)}" for i in range(900))
    whole = importance.counted(pa.array([text, None, text[:50]]))
    monkeypatch.setattr(importance, "PIECE", 64)
    cut = importance.counted(pa.array([text, None, text[:50]]))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert whole[0].tolist() == [900, 0, len(text_words(text[:50]))]


URLS = [None, "", "no scheme", "http://", "HTTP://A.Net/", "https://x.net", "https://x.net?q=/", "http://example.net/en/1", "http://sub.example.net/en/1?u=http://y.net/", "http://notexample.com/de/",
        "http://example.com/de/x", "http://a.example.com/de", "http://q.org/fr/9#top", "http://org/fr/", "http://q.org/FR/", "http://p.net:80/a", "a\nb://h.net/\nz?", "http://é.net/ß"]


def ruled(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fit = [r for r in url_models.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return host, path, max(fit, key=lambda r: len(r[0]), default=None)


def judged(urls):
    """(host, path, rule, verdict) by plain counting."""
    order, known = url_models.ORDER, [(u, *ruled(u)) for u in urls]
    aside = {u: zlib.crc32((u or "").encode()) % 5 == 0 for u in urls}
    marked = {u: "\x02" * order + (u or "").translate(LOWER) + "\x03" for u in urls}
    seen = {True: Counter(), False: Counter()}
    for u, _, _, rule in known:
        if rule and not aside[u]:
            for i in range(order, len(marked[u])):
                for k in range(order + 1):
                    seen[rule[3] == "allow"][marked[u][i - k:i + 1]] += 1
    follow = {m: defaultdict(list) for m in seen}
    for m, counts in seen.items():
        for s, n in counts.items():
            follow[m][s[:-1]].append(n)

    def chance(m, gram):
        p = url_models.FLOOR
        for k in range(order + 1):
            after = follow[m].get(gram[order - k:-1], [])
            if sum(after) >= url_models.LEAST:
                p = (seen[m][gram[order - k:]] + len(after) * p) / (sum(after) + len(after))
        return p

    def half_up(x):
        return math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)

    both = all(seen.values())
    steps = {}
    for u in set(urls):
        grams = [marked[u][i - order:i + 1] for i in range(order, len(marked[u]))]
        total = sum(half_up((math.log(chance(True, g)) - math.log(chance(False, g))) * 1e6) for g in grams)
        steps[u] = half_up(total / len(grams) * (url_models.STEPS / 1e6))
    told = [(steps[u], r[3] == "allow") for u, _, _, r in known if r and aside[u]]
    least = 0
    if {t[1] for t in told} == {True, False}:
        a, r = sum(t[1] for t in told), sum(not t[1] for t in told)
        tries = range(min(steps.values()) - 1, max(steps.values()) + 2)
        score = {t: sum((r if ok else a) for s, ok in told if (s >= t) == ok) for t in tries}
        least = min((t for t in tries if score[t] == max(score.values())), key=lambda t: (abs(t), t))
    return [(h, p, r and r[0], r[3] if r else "block" if both and steps[u] < least else "allow") for u, h, p, r in known]


def url_frame(spark, urls):
    return spark.createDataFrame([(i, u, "h", "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, steps int")


@pytest.mark.parametrize("share", [2000, 5])
def test_url_filter_matches_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(url_models, "SHARE", share)
    urls = URLS * 2 + [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = url_models.judge(url_frame(spark, urls)).orderBy("page_id").collect()
    assert [tuple(r)[1:5] for r in got] == judged(urls)


@pytest.mark.parametrize("urls", [[], ["http://a.net/x", None], ["http://example.net/en/1"] * 3])
def test_url_filter_without_one_kind(spark, urls):
    got = url_models.judge(url_frame(spark, urls)).orderBy("page_id").collect()
    assert [tuple(r)[1:5] for r in got] == judged(urls)


def test_models_tell_unseen_addresses(spark):
    """Held-out accuracy: hosts of two kinds of names, no rule for nine tenths of them."""
    rng = random.Random(11)
    name = lambda sounds: "".join(rng.choices(sounds, k=5))
    urls = [f"http://{name(['la', 'mi', 'ro'])}.good.info/{i}" for i in range(400)] + [f"http://{name(['xq', 'zz', 'kv'])}.bad.info/{i}" for i in range(400)]
    urls = [re.sub("good|bad", "site", u) if i % 10 else u for i, u in enumerate(urls)]
    rules = [("good.info/", "good.info", "/", "allow"), ("bad.info/", "bad.info", "/", "block")]
    got = url_models.judge(url_frame(spark, urls), rules=rules).where(F.col("rule").isNull()).collect()
    right = sum((r["verdict"] == "allow") == (r["page_id"] < 400) for r in got)
    assert len(got) == 720 and right >= 0.95 * 720


def test_join_by_share_loses_nothing(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    table = spark.createDataFrame([("hot", 1), ("500", 2), ("gone", 3)], "k string, v int")
    got = joined_by_share(rows, table, "k", 10)
    assert got.count() == 1000 and got.agg(F.sum("v")).first()[0] == 402


def test_registered_queries(spark):
    out = queries.QUERIES["op12_importance_resampling"](spark, SF)
    assert dict(out.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in out.collect()), key=str) == resampled(docs, target)
    out = queries.QUERIES["op13_url_filter"](spark, SF)
    assert {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}.items() <= dict(out.dtypes).items()
    pages = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()
    assert [tuple(r)[1:5] for r in out.orderBy("page_id").collect()] == judged([r["url"] for r in pages])
