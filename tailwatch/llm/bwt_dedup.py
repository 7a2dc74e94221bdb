"""Repeated byte strings across documents, by merging the suffix orders of shards.

Every string of 50 bytes that also starts in a document of smaller key is removed, overlaps included, judged on the input.

1. Shards (runs of stored rows) list the hashes of their anchors (see ``anchors``); a hash that two documents have marks
   places where strings may repeat. Lists travel as packed arrays, one for each shard and bucket of the hash range, each
   hash once a shard, with the number of its places. Hashes of more than ``HOT_WINDOWS`` places are hot.
2. Around each shared anchor a shard takes the 80 bytes that hold every 50-byte string with that anchor. Each distinct one
   goes, once a shard, to its anchor's bucket. There all strings that can be equal stand aligned on the anchor. Around a
   hot anchor, whose 80 bytes reach into each document's own text, the 50-byte strings themselves go, as 128-bit hashes,
   to buckets dealt by content: equal ones meet, and an anchor of any number of documents spreads over all tasks.
3. A bucket merges the shards' Burrows-Wheeler columns: the interleave starts as shard after shard, and each round refines
   it by one stable counting pass over the symbols that stand before the suffixes in the present order, as in merging
   BWTs by interleave iteration; suffixes are never compared or sorted anew. Since the strings are aligned, the transform
   is in its positional form, one column a round. At the 31 columns where a 50-byte string may start, neighbours' common
   prefixes cut the order into intervals of equal strings; each interval's smallest document is its owner.
4. Owners go back to the shards, as runs of start columns; shards mark the bytes and cut them.

Each step reads stored tables and writes one, so a lost executor repeats tasks only. What a shard gets back is stored in a
folder of its own, which the task that reads the shard opens.

Defined results: null text is empty; texts under 50 bytes lose nothing; a null key counts as larger than any other; rows
that repeat a key are not removed on each other's account; equal texts go but for the one of smallest key; an empty table
gives an empty one. Keys are integers; other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, pin
from . import anchors, store

BEFORE = anchors.SPAN - 1
WIDTH = BEFORE + anchors.LENGTH
STARTS = anchors.SPAN
#: Rows of a shard (two to this power), and bytes of text for each bucket of the hash range.
SHARD_BITS, BUCKET_BYTES = 13, 8 << 20
LAST = np.int64(1) << np.int64(62)
#: Places above which an anchor's strings are dealt by content; strings that a task gathers before it hands them on; and
#: buckets of such strings for each bucket of anchors.
HOT_WINDOWS, PIECES, PIECE_BUCKETS = 1 << 14, 1 << 20, 4

_rng = np.random.default_rng(50)
_WEIGHTS = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)
_SYMBOLS = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_FACTORS = _rng.integers(1, 1 << 63, (2, 8), dtype=np.uint64) | np.uint64(1)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """_row (all columns of ``docs`` but the text), kept (the bytes that remain), n_bytes, n_removed, n_spans and cuts
    (start and stop of each removed run, alternating)."""
    rest = [c for c in docs.columns if c != text]
    rows = pin(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.coalesce(F.col(key).cast("long"), F.lit(int(LAST))).alias("key"), F.col(text).alias("text"),
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("bytes"), F.shiftright(F.monotonically_increasing_id(), SHARD_BITS).alias("shard")))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    folder = f"{checkpoint_dir(docs.sparkSession)}/repeats-{uuid.uuid4().hex}"
    plain = rows.select("shard", "key", "text")

    listed = plain.mapInArrow(_lists(buckets), "bucket int, shard long, hashes binary, many binary, counts binary")
    shared = listed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared(hot_windows), "shard long, hashes binary, hot binary")
    shared.repartition("shard").write.partitionBy("shard").parquet(f"{folder}/shared")

    strings = plain.mapInArrow(_strings(buckets, f"{folder}/shared"), "bucket int, shard long, least binary, most binary, names binary, ranges binary, strings binary")
    owners = strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_owners(buckets), "shard long, names binary, first binary, stop binary, owner binary, pieces binary, earliest binary")
    owners.repartition("shard").write.partitionBy("shard").parquet(f"{folder}/owners")

    kind = rows.schema["_row"].dataType.simpleString()
    cut = _cut(f"{folder}/shared", f"{folder}/owners")
    return rows.select("_row", "shard", "key", "text").mapInArrow(cut, f"_row {kind}, kept binary, n_bytes long, n_removed long, n_spans long, cuts array<long>")


#: In hexadecimal: bytes of a character whose beginning was cut away, and the beginning of one whose end was.
_HEADLESS, _TAILLESS = "^(?:[89AB][0-9A-F])+", "(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$"


def kept_text() -> F.Column:
    """The kept bytes as text, from kept, cuts and n_bytes. A character that a cut went through is dropped; all others stay as they are."""
    whole = f"decode(unhex(regexp_replace(regexp_replace(hex(substring(kept, s.pos + 1, p.b - p.a)), '{_HEADLESS}', ''), '{_TAILLESS}', '')), 'UTF-8')"
    pieces = "transform(sequence(0, size(cuts) div 2), k -> named_struct('a', if(k = 0, 0L, get(cuts, 2 * k - 1)), 'b', if(k = size(cuts) div 2, n_bytes, get(cuts, 2 * k))))"
    return F.expr(f"aggregate({pieces}, named_struct('pos', 0, 'out', ''), (s, p) -> named_struct('pos', cast(s.pos + p.b - p.a as int), 'out', concat(s.out, {whole})), s -> s.out)"
                  .replace("p.b - p.a)", "cast(p.b - p.a as int))"))


# Within tasks --------------------------------------------------------------------------------------------------------

def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Shards in turn, each with the batches (or parts of them) that hold it."""
    def parts():
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            edges = np.flatnonzero(names[1:] != names[:-1]) + 1
            for a, b in zip([0, *edges], [*edges, len(names)], strict=True):
                if b > a:
                    yield int(names[a]), batch.slice(a, b - a)

    stream = parts()
    ahead = next(stream, None)

    def own(name):
        nonlocal ahead
        while ahead is not None and ahead[0] == name:
            batch = ahead[1]
            yield batch
            ahead = next(stream, None)

    while ahead is not None:
        name = ahead[0]
        yield name, own(name)
        while ahead is not None and ahead[0] == name:
            ahead = next(stream, None)


def _texts(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None]]:
    for batch in parts:
        yield from zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)


def _lists(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _by_shard(batches):
            hashes, many, counts = np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
            waiting, keys = [], []
            for tags, data, bounds in anchors.chunks(_texts(parts)):
                at, h = anchors.find(data, bounds)
                waiting.append(h)
                keys.append(np.array(tags, np.int64)[np.searchsorted(bounds, at, "right") - 1])
            if waiting:
                hashes, many, counts = _distinct(np.concatenate(waiting), np.concatenate(keys))
            if not len(hashes):
                continue
            bucket = (hashes % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            which, starts = np.unique(bucket[order], return_index=True)
            for b, ix in zip(which, np.split(order, starts[1:]), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([shard]), pa.array([hashes[ix].tobytes()]), pa.array([many[ix].tobytes()]), pa.array([counts[ix].tobytes()])],
                                                 ["bucket", "shard", "hashes", "many", "counts"])
    return run


def _distinct(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each hash once, whether several documents have it, and how often it occurs."""
    order = np.argsort(hashes, kind="stable")
    hashes, keys = hashes[order], keys[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    if not len(hashes):
        return hashes, np.zeros(0, bool), np.zeros(0, np.int64)
    return hashes[first], np.minimum.reduceat(keys, first) != np.maximum.reduceat(keys, first), np.diff(np.append(first, len(hashes)))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one bucket together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _shared(hot_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            parts = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
            get = lambda c, kind: np.concatenate([np.frombuffer(r[c], kind) for r in rows])  # noqa: B023, E731
            _, inverse, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            repeated = count > 1
            repeated |= np.bincount(inverse, get("many", bool), len(count)) > 0
            hot = np.bincount(inverse, get("counts", np.int64), len(count)) > hot_windows
            ends = np.cumsum([len(p) for p in parts])[:-1]
            keep, hot = np.split(repeated[inverse], ends), np.split(hot[inverse], ends)
            out = [(r["shard"], p[k].tobytes(), x[k].tobytes()) for r, p, k, x in zip(rows, parts, keep, hot, strict=True) if k.any()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["shard", "hashes", "hot"])
    return run


def _side(folder: str, shard: int) -> dict[str, np.ndarray]:
    """What was stored for a shard, column by column."""
    kinds = {"hashes": np.uint64, "hot": bool, "pieces": np.uint64, "earliest": np.int64, "names": np.uint64, "first": np.uint8, "stop": np.uint8, "owner": np.int64}
    system, path = store.located(f"{folder}/shard={shard}")
    from pyarrow import fs
    files = [f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
    tables = [pq.ParquetFile(system.open_input_file(f)).read() for f in sorted(files)]
    return {c: np.frombuffer(b"".join(x for t in tables for x in t.column(c).to_pylist()), k) for c, k in kinds.items() if tables and c in tables[0].column_names}


def _anchors(folder: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard's shared anchors in order, and those of them that are hot."""
    side = _side(folder, shard)
    ordered, first = np.unique(side.get("hashes", np.zeros(0, np.uint64)), return_index=True)
    return ordered, ordered[side.get("hot", np.zeros(0, bool))[first]]


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _around(data: np.ndarray, bounds: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, ...]:
    """Shared anchors of a chunk: place, hash, document index, 80 bytes around, their valid range, and a 64-bit name."""
    at, h = anchors.find(data, bounds)
    hit = _is_in(h, ordered)
    at, h = at[hit], h[hit]
    doc = np.searchsorted(bounds, at, "right") - 1
    first = np.maximum(0, bounds[doc] - (at - BEFORE))
    stop = np.minimum(WIDTH, bounds[doc + 1] - (at - BEFORE))
    padded = np.concatenate((np.zeros(BEFORE, np.uint8), data, np.zeros(WIDTH, np.uint8)))
    around = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[at] if len(at) else np.zeros((0, WIDTH), np.uint8)
    column = np.arange(WIDTH)
    inside = (column >= first[:, None]) & (column < stop[:, None])
    around = np.where(inside, around, np.uint8(0))
    name = ((around.astype(np.uint64) + inside) * _WEIGHTS).sum(axis=1)
    name ^= name >> np.uint64(32)
    return at, h, doc, around, np.stack((first, stop), 1).astype(np.uint8), name


def _strings(buckets: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for shard, parts in _by_shard(batches):
            ordered, hot = _anchors(folder, shard)
            if not len(ordered):
                continue
            held: list[tuple] = []
            pieces: list[tuple] = []
            for tags, data, bounds in anchors.chunks(_texts(parts)):
                _, h, doc, around, ranges, name = _around(data, bounds, ordered)
                once = _once(h, np.array(tags, np.int64)[doc], np.array(tags, np.int64)[doc], around, ranges, name)
                by_content = _is_in(once[0], hot)
                held.append(tuple(x[~by_content] for x in once))
                if by_content.any():
                    pieces.append(_distinct_pieces(*(once[i][by_content] for i in (1, 2, 3, 4))))
                    if sum(len(x[0]) for x in pieces) >= PIECES:
                        yield from _dealt_pieces(shard, pieces, buckets, packer)
                        pieces = []
            yield from _dealt_pieces(shard, pieces, buckets, packer)
            if not any(len(x[0]) for x in held):
                continue
            h, least, most, around, ranges, name = _once(*map(np.concatenate, zip(*held, strict=True)))
            bucket = (h % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            which, starts = np.unique(bucket[order], return_index=True)
            for b, ix in zip(which, np.split(order, starts[1:]), strict=True):
                blobs = [least[ix].tobytes(), most[ix].tobytes(), name[ix].tobytes(), ranges[ix].tobytes(), packer.compress(around[ix].tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([shard]), *[pa.array([x]) for x in blobs]],
                                                 ["bucket", "shard", "least", "most", "names", "ranges", "strings"])
    return run


def piece_hashes(around: np.ndarray) -> np.ndarray:
    """(windows, start columns, 2): two 64-bit hashes of the 50 bytes from each start column, by mixed doubling."""
    out = np.empty((len(around), STARTS, 2), np.uint64)

    def joined(left, right, factor):
        h = left * factor + right
        h ^= h >> np.uint64(31)
        h *= factor
        h ^= h >> np.uint64(29)
        return h

    for i in range(0, len(around), 4096):
        for k in range(2):
            h, kept = _SYMBOLS[k][around[i:i + 4096]], {}
            for n, step in enumerate((1, 2, 4, 8, 16)):
                h = kept[2 * step] = joined(h[:, :-step], h[:, step:], _FACTORS[k, n])
            h = joined(kept[32][:, :STARTS], kept[16][:, 32:32 + STARTS], _FACTORS[k, 5])
            out[i:i + 4096, :, k] = joined(h, kept[2][:, 48:48 + STARTS], _FACTORS[k, 6])
    return out


def _valid(ranges: np.ndarray) -> np.ndarray:
    """Start columns from which 50 bytes are the document's."""
    column = np.arange(STARTS)
    return (ranges[:, :1] <= column) & (ranges[:, 1:] >= column + anchors.LENGTH)


def _same_pieces(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal strings follow each other, and where each begins."""
    order = np.lexsort((names[:, 1], names[:, 0]))
    names = names[order]
    return order, np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]).any(axis=1))))


def _distinct_pieces(least: np.ndarray, most: np.ndarray, around: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each 50-byte string of these windows once: name, smallest and largest document."""
    window, column = np.nonzero(_valid(ranges))
    return _fewer_pieces(piece_hashes(around)[window, column], least[window], most[window])


def _fewer_pieces(names: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(names):
        return names, least, most
    order, first = _same_pieces(names)
    return names[order[first]], np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)


def _dealt_pieces(shard: int, pieces: list[tuple], buckets: int, packer) -> Iterator[pa.RecordBatch]:
    if not pieces:
        return
    names, least, most = _fewer_pieces(*map(np.concatenate, zip(*pieces, strict=True)))
    bucket = (buckets + names[:, 0] % np.uint64(PIECE_BUCKETS * buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    which, starts = np.unique(bucket[order], return_index=True)
    for b, ix in zip(which, np.split(order, starts[1:]), strict=True):
        blobs = [packer.compress(least[ix].tobytes()), packer.compress((most[ix] - least[ix]).tobytes()), names[ix].tobytes(), b"", b""]
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([shard]), *[pa.array([x]) for x in blobs]],
                                         ["bucket", "shard", "least", "most", "names", "ranges", "strings"])


def _piece_owners(rows: list[dict], unpack) -> Iterator[pa.RecordBatch]:
    """The smallest document of each string, to the shards where a larger one has it."""
    sizes = [len(r["names"]) // 16 for r in rows]
    far = lambda c: np.concatenate([np.frombuffer(unpack.decompress(r[c], max_output_size=8 * n), np.int64) for r, n in zip(rows, sizes, strict=True)])
    names, least = np.concatenate([np.frombuffer(r["names"], np.uint64) for r in rows]).reshape(-1, 2), far("least")
    order, first = _same_pieces(names)
    owner = np.empty(len(names), np.int64)
    owner[order] = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(names))))
    need = owner < least + far("most")
    ends = np.cumsum(sizes)[:-1]
    for r, name, own, k in zip(rows, np.split(names, ends), np.split(owner, ends), np.split(need, ends), strict=True):
        if k.any():
            yield pa.RecordBatch.from_arrays([pa.array([r["shard"]]), *[pa.array([x]) for x in (b"", b"", b"", b"", name[k].tobytes(), own[k].tobytes())]], _OWNED)


def _once(h, least, most, around, ranges, name) -> tuple[np.ndarray, ...]:
    """Each named string once, with the smallest and largest document that has it."""
    if not len(name):
        return h, least, most, around, ranges, name
    order = np.argsort(name, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1])))
    one = order[first]
    return h[one], np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first), around[one], ranges[one], name[one]


def merged_owners(strings: np.ndarray, ranges: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For aligned strings, shard after shard: the smallest key among those that equal it in the 50 bytes from each of
    the start columns; LAST where those bytes are not all its document's."""
    n = len(strings)
    columns = np.ascontiguousarray(strings.T)
    owners = np.full((n, STARTS), LAST, np.int64)
    interleave = np.arange(n)
    for column in range(WIDTH - 1, -1, -1):
        # the symbols before the suffixes, in the present order: one stable counting pass places each shard's suffixes anew
        interleave = interleave[np.argsort(columns[column][interleave], kind="stable")]
        if column < STARTS:
            valid = (ranges[interleave, 0] <= column) & (ranges[interleave, 1] >= column + anchors.LENGTH)
            seen = strings[interleave, column:column + anchors.LENGTH]
            new = np.flatnonzero(np.concatenate(([True], (seen[1:] != seen[:-1]).any(axis=1))))
            least = np.minimum.reduceat(np.where(valid, keys[interleave], LAST), new)
            owner = np.repeat(least, np.diff(np.append(new, n)))
            owners[interleave, column] = np.where(valid, owner, LAST)
    return owners


_OWNED = ["shard", "names", "first", "stop", "owner", "pieces", "earliest"]


def _owners(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for rows in _buckets(batches):
            if rows[0]["bucket"] >= buckets:
                yield from _piece_owners(rows, unpack)
                continue
            get = lambda c, kind: np.concatenate([np.frombuffer(r[c], kind) for r in rows])  # noqa: B023, E731
            sizes = [len(r["names"]) // 8 for r in rows]
            strings = np.concatenate([np.frombuffer(unpack.decompress(r["strings"], max_output_size=n * WIDTH), np.uint8).reshape(n, WIDTH) for r, n in zip(rows, sizes, strict=True)])
            owners = merged_owners(strings, get("ranges", np.uint8).reshape(-1, 2), get("least", np.int64))
            names = get("names", np.uint64)
            need = owners < get("most", np.int64)[:, None]
            # runs of start columns with one owner, wherever some document of the shard loses bytes to it
            change = np.ones((len(owners), STARTS + 1), bool)
            change[:, 1:-1] = (owners[:, 1:] != owners[:, :-1]) | (need[:, 1:] != need[:, :-1])
            begins, ends = need & change[:, :-1], need & change[:, 1:]
            at, first = np.nonzero(begins)
            stop = np.nonzero(ends)[1] + 1
            shard = np.searchsorted(np.cumsum(sizes), at, "right")
            which, starts = np.unique(shard, return_index=True)
            out = [(rows[s]["shard"], names[at[ix]].tobytes(), first[ix].astype(np.uint8).tobytes(), stop[ix].astype(np.uint8).tobytes(), owners[at[ix], first[ix]].tobytes(), b"", b"")
                   for s, ix in zip(which, np.split(np.arange(len(at)), starts[1:]), strict=True)] if len(at) else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], _OWNED)
    return run


def _cut(shared: str, owned: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _by_shard(batches):
            ordered, hot = _anchors(shared, shard)
            runs = _side(owned, shard)
            pieces, earliest = runs.pop("pieces", np.zeros(0, np.uint64)).reshape(-1, 2), runs.pop("earliest", np.zeros(0, np.int64))
            pieces, earliest, _ = _fewer_pieces(pieces, earliest, earliest)
            if "names" not in runs:
                runs = {"names": np.zeros(0, np.uint64), "first": np.zeros(0, np.uint8), "stop": np.zeros(0, np.uint8), "owner": np.zeros(0, np.int64)}
            order = np.argsort(runs["names"], kind="stable")
            runs = {c: v[order] for c, v in runs.items()}
            for batch in parts:
                done = []
                for tags, data, bounds in anchors.chunks(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    gone = _marked(np.array(tags, np.int64), data, bounds, ordered, runs, hot, pieces, earliest)
                    done += [_result(data[a:b], gone[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                kept, size, removed, spans, cuts = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (size, removed, spans)], pa.array(cuts, pa.list_(pa.int64()))],
                                                 ["_row", "kept", "n_bytes", "n_removed", "n_spans", "cuts"])
    return run


def _marked(keys: np.ndarray, data: np.ndarray, bounds: np.ndarray, ordered: np.ndarray, runs: dict[str, np.ndarray],
            hot: np.ndarray, pieces: np.ndarray, earliest: np.ndarray) -> np.ndarray:
    """Bytes that are covered by a string of an earlier document."""
    if not len(ordered) or not (len(runs["names"]) or len(pieces)):
        return np.zeros(len(data), bool)
    at, h, doc, around, ranges, name = _around(data, bounds, ordered)
    lo, hi = np.searchsorted(runs["names"], name, "left"), np.searchsorted(runs["names"], name, "right")
    count = hi - lo
    which = np.repeat(np.arange(len(at)), count)
    run = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
    earlier = runs["owner"][run] < keys[doc[which]]
    which, run = which[earlier], run[earlier]
    first = at[which] - BEFORE + runs["first"][run]
    stop = at[which] - BEFORE + runs["stop"][run] - 1 + anchors.LENGTH
    depth = np.bincount(first, minlength=len(data) + 1) - np.bincount(stop, minlength=len(data) + 1)
    by_content = np.flatnonzero(_is_in(h, hot))
    if len(by_content) and len(pieces):
        _, one, same = np.unique(name[by_content], return_index=True, return_inverse=True)
        owner = _piece_owner(around[by_content[one]], ranges[by_content[one]], pieces, earliest)
        for i in range(0, len(by_content), 1 << 16):
            part = by_content[i:i + (1 << 16)]
            which, column = np.nonzero(owner[same[i:i + (1 << 16)]] < keys[doc[part]][:, None])
            first = at[part[which]] - BEFORE + column
            depth += np.bincount(first, minlength=len(data) + 1) - np.bincount(first + anchors.LENGTH, minlength=len(data) + 1)
    return np.cumsum(depth)[:len(data)] > 0


def _piece_owner(around: np.ndarray, ranges: np.ndarray, pieces: np.ndarray, earliest: np.ndarray) -> np.ndarray:
    """Owner of the 50 bytes from each start column; LAST where there is none. ``pieces`` are in order."""
    owner = np.full((len(around), STARTS), LAST, np.int64)
    window, column = np.nonzero(_valid(ranges))
    asked = piece_hashes(around)[window, column]
    at = np.minimum(np.searchsorted(pieces[:, 0], asked[:, 0]), len(pieces) - 1)
    while True:  # on, where two strings have the first hash in common
        on = (pieces[at, 0] == asked[:, 0]) & (pieces[at, 1] < asked[:, 1]) & (at < len(pieces) - 1)
        if not on.any():
            break
        at[on] += 1
    hit = (pieces[at] == asked).all(axis=1)
    owner[window[hit], column[hit]] = earliest[at[hit]]
    return owner


def _result(data: np.ndarray, gone: np.ndarray) -> tuple:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    return data[~gone].tobytes(), len(data), int(gone.sum()), len(edge) // 2, edge.tolist()
