"""Pivot index: keys, lengths, growth of the pivots, and the registered query against its SQL where there are links."""

import duckdb
import numpy as np
import pytest

from tailwatch.llm import language_id, pivots, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def clusters(rng, n, d, size, low=0.93):
    """Vectors in groups of about ``size``, near each other at cosines from about ``low`` on."""
    centre = rng.normal(size=(max(1, n // size), d))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    own = centre[rng.integers(0, len(centre), n)]
    noise = rng.normal(size=(n, d))
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    share = rng.uniform(np.sqrt(low), 1, n)[:, None]
    return (own * share + noise * np.sqrt(1 - share ** 2)).astype("float32")


def brute(ids, v, least=0.93):
    """n_links and component of rows of one label and length; copies included."""
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    close = unit @ unit.T >= least
    np.fill_diagonal(close, False)
    root = list(range(len(v)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in np.argwhere(np.triu(close)):
        root[find(i)] = find(j)
    names = {}
    for i, k in enumerate(ids):
        if k is not None:
            names[find(i)] = min(k, names.get(find(i), k))
    return [(k, int(close[i].sum()), names.get(find(i))) for i, k in enumerate(ids)]


def test_null_and_repeated_keys_stay_rows_of_their_own(spark):
    a, b, c, e = [1.0, 0.0, 0.0, 0.0], [0.99, 0.1, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]
    rows = [(None, a, 1), (7, b, 1), (7, c, 1), (7, b, 1), (8, c, 1), (None, e, 1), (9, a, 2), (None, None, 1), (None, a, None), (None, e, 3), (None, e, 3)]
    got = sorted((tuple(r) for r in pivots.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = [(None, 2, 7), (7, 2, 7), (7, 1, 7), (7, 2, 7), (8, 1, 7), (None, 0, None), (9, 0, 9), (None, 0, None), (None, 0, None), (None, 1, None), (None, 1, None)]
    assert got == sorted(want, key=str)


def test_every_length_is_indexed(spark):
    rng = np.random.default_rng(2)
    rows, want, n = [], [], 0
    for d in range(1, 71):
        v = clusters(rng, 12, d, 4)
        ids = list(range(n, n + 12))
        n += 12
        rows += [(i, x.tolist(), 5) for i, x in zip(ids, v, strict=True)]
        want += brute(ids, v)
    got = {r.vec_id: r for r in pivots.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    links = sum(w[1] for w in want)
    assert sum(r.n_links for r in got.values()) >= 0.95 * links and all(got[i].n_links <= k for i, k, _ in want)


@pytest.mark.parametrize("n,d,size", [(600, 64, 3), (3000, 64, 3), (6000, 32, 4)])
def test_recall_holds_as_pivots_grow(spark, n, d, size):
    v = clusters(np.random.default_rng(n), n, d, size)
    got = {r.vec_id: r.n_links for r in pivots.near_vectors(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], SCHEMA)).collect()}
    want = brute(list(range(n)), v)
    recall = sum(got.values()) / sum(w[1] for w in want)
    print(f"{n} rows of {d}: {pivots.pivot_count(n)} pivots, {pivots.places(pivots.pivot_count(n))} places, recall {recall:.4f}")
    assert recall >= 0.95 and all(got[i] <= k for i, k, _ in want)


def test_a_pair_counts_in_one_list():
    rng = np.random.default_rng(1)
    near = np.stack([rng.permutation(30)[:8] for _ in range(400)]).astype(np.int32)
    lists = pivots._lists_of(near)
    a, b = np.triu_indices(400, 1)
    first = pivots._first_lists(near[a], near[b])
    for i, j, f in zip(a, b, first, strict=True):
        common = np.intersect1d(near[i], near[j])
        if len(common) >= 3:
            assert f in lists[i] and f in lists[j]


def test_registered_query_equals_sql_where_there_are_links(spark, tmp_path):
    rng = np.random.default_rng(6)
    v = clusters(rng, 900, 64, 3, low=0.97)
    rows = [(i, x.tolist(), int(i % 4)) for i, x in enumerate(v)] + [(1000 + i, v[i].tolist(), int(i % 4)) for i in range(50)] + [(2000, None, 1), (2001, [0.0] * 64, 1), (2002, v[0].tolist(), None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["op8_pivot_near_dedup"](spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({queries.SQL['op8_pivot_near_dedup']})").fetchall())
    assert sum(r[1] for r in want) > 500
    assert got == want


def test_signs_that_are_no_letters_have_no_language(spark):
    model = {"en": b"the cat and the dog", "de": b"der hund und die katze"}
    texts = ["½ ½", "²", "①②", "٣", "x", "the cat", "__", "é"]
    got = [r.lang_pred for r in language_id.classify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert [g == "und" for g in got] == [True, True, True, True, False, False, True, False]
