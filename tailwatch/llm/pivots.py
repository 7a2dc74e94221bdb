"""Embedding near duplicates through a pivot-permutation index, verified by exact cosines.

A vector is described by its nearest reference points (pivots), in order of nearness. Vectors that share at least ``SHARED``
of them are candidates: each combination of that many pivots is an inverted list, so sharing enough pivots means sharing a
list. Lists are cut into blocks and blocks are compared pair by pair in double precision, so no list has to fit a task. A
pair counts in one of the lists that it shares: that of the common pivots which stand first in both orders (least sum of
places). A task hands on, for each vector of a block pair, how many links it found and the least vector of its linked part:
never the pairs themselves.

The number of pivots grows with the square root of the vectors of the largest label (``pivot_count``), so that the lists
that a vector shares by chance stay as many however many vectors there are; the described places grow with the pivots
(``places``), so that near vectors keep sharing enough. Pivots are a bounded sample, a few times their number of vectors of
smallest hash, of which no two chosen are closer than cosine ``APART``: a dense group gives one pivot however many rows it
holds. Every row is indexed; fewer pivots make longer lists, never lost ones. Equal vectors of a label are one
representative with a count, so copies cost nothing. Recall against brute force is in README.

Defined results: null labels, null or empty or zero vectors and those with null or non-finite components are linked with
nothing; vectors of different length are not compared, and each length has its own pivots; rows are told apart by label
and vector, not by key: a key that occurs with several vectors is as many rows, each with its own links; a component's
name is the least key that is not null in it, null where there is none; an empty table gives an empty one. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from .common import components

SHARED = 3
FEWEST_PIVOTS, MOST_PIVOTS = 64, (1 << 20) - 1
#: Vectors drawn for each pivot, and the cosine above which two are not both chosen.
DRAWN, APART = 4, 0.7
BLOCK_ROWS = 1024
#: Rows compared at a time, and the length up to which lists are compared many at once.
CHUNK_ROWS, SMALL_LIST = 8192, 64


def pivot_count(rows: int) -> int:
    """The power of two next to four times the square root."""
    return min(MOST_PIVOTS, max(FEWEST_PIVOTS, 1 << round(np.log2(4 * max(rows, 1) ** 0.5))))


def places(pivots: int) -> int:
    """Described places: eight, and one more for each doubling of the pivots above 512."""
    return 8 + max(0, (pivots - 1).bit_length() - 9)


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93) -> DataFrame:
    """One row per vector: key, n_links, component."""
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.coalesce(F.col("label").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    copies = rows.where("usable").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    reps = pin(copies.withColumn("d", F.size("v")).withColumn("u", F.monotonically_increasing_id()))
    found = pin(_compared(reps, _sample(reps), least))
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    groups = pin(components(reps.select(F.col("u").alias("id")), found.where("root < u").select(F.col("u").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "u"))
    known = pin(reps.select("label", "v", "u", "rep", "n").join(links, "u", "left").join(groups, "u"))
    names = known.groupBy("component").agg(F.min("rep").alias("name"))
    known = known.join(names, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("name").alias("component"))
    linked = rows.where("usable").select("id", "label", "v").join(known, ["label", "v"]).select("id", "n_links", "component")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumnRenamed("id", key)


def _sample(reps: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by vector length, none close to another. A row a length comes back, and a sample in proportion to the pivots."""
    sizes = reps.groupBy("d", "label").agg(F.count("*").alias("n")).groupBy("d").agg(F.max("n").alias("n")).collect()
    wanted = {r["d"]: pivot_count(r["n"]) for r in sizes}
    if not wanted:
        return {}
    # the rank limit is applied before the shuffle
    rank = F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64("v", "label"), "u"))
    drawn: dict[int, list] = {}
    for row in reps.withColumn("r", rank).where(F.col("r") <= DRAWN * max(wanted.values())).select("d", "r", "v").collect():
        drawn.setdefault(row["d"], []).append((row["r"], row["v"]))
    return {d: _thinned(_unit(np.array([v for r, v in sorted(vs) if r <= DRAWN * wanted[d]])), wanted[d]) for d, vs in drawn.items()}


def _thinned(units: np.ndarray, most: int) -> np.ndarray:
    """The first vectors, in the given order, that are not close to one before them."""
    chosen = np.empty((most, units.shape[1]))
    n = 0
    for u in units:
        if n == most:
            break
        if not n or (chosen[:n] @ u).max() <= APART:
            chosen[n] = u
            n += 1
    return chosen[:n]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _lists_of(near: np.ndarray) -> np.ndarray:
    """Numbers of the inverted lists of each row: its combinations of ``SHARED`` pivots; one list where there are fewer pivots."""
    if near.shape[1] < SHARED:
        return np.zeros((len(near), 1), np.int64)
    ordered = np.sort(near, axis=1).astype(np.int64)
    return np.stack([sum(ordered[:, c] << (20 * (SHARED - 1 - i)) for i, c in enumerate(combo)) for combo in combinations(range(near.shape[1]), SHARED)], axis=1)


def _first_lists(near_a: np.ndarray, near_b: np.ndarray) -> np.ndarray:
    """The list in which each pair counts: the common pivots of least summed places."""
    if near_a.shape[1] < SHARED:
        return np.zeros(len(near_a), np.int64)
    same = near_a[:, :, None] == near_b[:, None, :]
    place = np.arange(near_a.shape[1]) + same.argmax(axis=2)
    rank = np.where(same.any(axis=2), (place << 20) + near_a, np.int64(1) << 60)
    first = np.sort(np.sort(rank, axis=1)[:, :SHARED] & ((1 << 20) - 1), axis=1)
    return sum(first[:, i] << (20 * (SHARED - 1 - i)) for i in range(SHARED))


def _arrays(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def _compared(reps: DataFrame, pivots: dict[int, np.ndarray], least: float) -> DataFrame:
    """(u, links, root) from each pair of blocks of each list."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            for d in np.unique(lengths):
                own = batch.filter(pa.array(lengths == d))
                near = np.argsort(-(_unit(_matrix(own.column(1), d)) @ pivots[d].T), axis=1, kind="stable")[:, :places(len(pivots[d]))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), own.column(3), own.column(4), _arrays(near), _arrays(_lists_of(near))],
                                                 ["u", "v", "d", "label", "n", "near", "lists"])

    kinds = dict(reps.dtypes)
    described = pin(reps.select("u", "v", "d", "label", "n").mapInArrow(describe, f"u long, v {kinds['v']}, d int, label {kinds['label']}, n long, near array<int>, lists array<long>"))
    listed = described.select("u", "label", "d", F.explode("lists").alias("list"))
    blocks = (listed.groupBy("label", "d", "list").agg(F.count("*").alias("m")).where("m > 1")
              .withColumn("blocks", F.ceil(F.col("m") / BLOCK_ROWS).cast("int")).drop("m"))
    # lists of one vector are left out before vectors travel
    live = listed.join(pin(blocks), ["label", "d", "list"]).select("u", "list", "blocks")
    mine = F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")
    dealt = live.join(described.drop("lists"), "u").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.concat_ws("|", F.col("label").cast("string"), "d", "list", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"),
                         (F.col("mine") <= F.col("other")).cast("int").alias("side"), "u", "v", "n", "near", "list", "d", (F.col("mine") == F.col("other")).alias("within"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            names = rows["task"].to_numpy()
            group = np.concatenate(([0], np.cumsum(names[1:] != names[:-1])))
            size = np.bincount(group)
            small = ((size <= SMALL_LIST) & rows["within"].to_numpy()[np.searchsorted(group, np.arange(len(size)))])[group]
            length = rows["d"].to_numpy()
            for d in np.unique(length[small]):
                yield from _links(_small_lists(rows.filter(pa.array(small & (length == d))), int(d), least))
            for g in np.flatnonzero(~small[np.searchsorted(group, np.arange(len(size)))] & (size > 1)):
                lo = int(np.searchsorted(group, g))
                yield from _links(_block_pair(rows.slice(lo, int(size[g])), int(length[lo]), least))

    spread = dealt.repartition("task").sortWithinPartitions("task")
    return spread.mapInArrow(compare, "u long, links long, root long")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about ``CHUNK_ROWS`` rows; rows of one task name, which follow each other, stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if sum(b.num_rows for b in held) >= CHUNK_ROWS:
            names, last = batch.column(0).to_numpy(zero_copy_only=False), held[-1].column(0)[-1].as_py()
            other = np.flatnonzero(names != last)
            if len(other):
                yield pa.Table.from_batches([*held, batch.slice(0, int(other[0]))])
                held, batch = [], batch.slice(int(other[0]))  # noqa: PLW2901
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _links(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    ids, links, root = found
    keep = (links > 0) | (root < ids)
    if keep.any():
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(links[keep]), pa.array(root[keep])], ["u", "links", "root"])


def _small_lists(rows: pa.Table, d: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs within each of many short lists, by the distance of their rows."""
    names, ids = rows["task"].to_numpy(), rows["u"].to_numpy()
    group = np.concatenate(([0], np.cumsum(names[1:] != names[:-1])))
    units, near = _unit(_matrix(rows["v"].combine_chunks(), d)), _matrix(rows["near"].combine_chunks(), len(rows["near"][0]))
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, len(ids)):
        i = np.flatnonzero(group[:-step] == group[step:])
        if not len(i):
            break
        i = i[np.einsum("ij,ij->i", units[i], units[i + step]) >= least]
        first.append(i), second.append(i + step)
    a, b = np.concatenate(first), np.concatenate(second)
    root, before = ids.copy(), None
    while before is None or (root != before).any():
        before, low = root.copy(), np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
    return ids, _counted(near, a, b, rows["list"].to_numpy()[a], rows["n"].to_numpy()), root


def _block_pair(rows: pa.Table, d: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a long list's block, or of two blocks."""
    ids = rows["u"].to_numpy()
    units, near = _unit(_matrix(rows["v"].combine_chunks(), d)), _matrix(rows["near"].combine_chunks(), len(rows["near"][0]))
    close = units @ units.T >= least
    np.fill_diagonal(close, False)
    if not rows["within"][0].as_py():
        side = rows["side"].to_numpy()
        close &= side[:, None] != side[None, :]
    a, b = np.nonzero(np.triu(close))
    return ids, _counted(near, a, b, np.full(len(a), rows["list"][0].as_py()), rows["n"].to_numpy()), _roots(close, ids)


def _counted(near: np.ndarray, a: np.ndarray, b: np.ndarray, own: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Links of each row: those of the pairs that count in this list."""
    links = np.zeros(len(near), np.int64)
    for lo in range(0, len(a), 1 << 17):
        x, y = a[lo:lo + (1 << 17)], b[lo:lo + (1 << 17)]
        here = _first_lists(near[x], near[y]) == own[lo:lo + (1 << 17)]
        np.add.at(links, x[here], mult[y[here]])
        np.add.at(links, y[here], mult[x[here]])
    return links


def _roots(close: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id of each connected part of a block pair."""
    root = ids.copy()
    while True:
        new = np.minimum(root, np.where(close, root[None, :], np.iinfo(root.dtype).max).min(axis=1))
        if (new == root).all():
            return root
        root = new
