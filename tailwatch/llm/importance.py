"""Target-distribution importance resampling with bit-sliced weights.

Features of a text are all runs of one to ``RUNS`` consecutive words, hashed into ``BUCKETS`` buckets. A bucket's gain is
the scaled logarithm of its share in the target over its share in the corpus, as an integer; a text's weight is the sum of
the gains of its features. Bit-sliced: plane j of a text has a bit for each bucket whose count has bit j, and plane k of
the gains a bit for each bucket whose gain (in two's complement) has bit k. The weight is then the sum over j and k of the
population count of (plane j AND plane k) times 2^(j+k), negative for the sign plane: exact integers, no multiplication
per feature. A Gumbel draw from the key's hash is added, and the rows of highest score are drawn without replacement.

Two passes read the texts: one adds up the corpus's bucket counts (at most ``BUCKETS`` rows reach the driver, whatever the
input), one weighs the rows. Ranks come from one range partitioning of narrow rows and one row count a partition.

The CRC of a run of words is put together from the CRCs of its words: a CRC is linear, so appending m bytes moves it
through a table for m, and whole batches of runs are hashed by table look-ups.

Defined results: null and empty texts have no words, no features and weight 0, and are never drawn with ``least_words``
above 0; texts of any length are read in pieces of about ``PIECE`` bytes that overlap by two words; a null key is hashed
as the word null; rows of equal score and key are ranked in the order in which they are stored; an empty table gives an
empty one; an empty target gives gains of the corpus against nothing. Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import running_offsets

BUCKETS, RUNS = 10_000, 3
#: Bytes of text that are split into words at a time.
PIECE = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: A word is a run of letters a-z, digits and bytes from 0x80 on; A-Z are lowered, all else parts words.
_SIGNS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CRC_POLYNOMIAL = 0xEDB88320
_BLANK = zlib.crc32(b" ")


def _tables(images: np.ndarray) -> np.ndarray:
    """Look-up tables (4 x 256) of the linear map that sends bit i to images[i]."""
    out = np.zeros((4, 256), np.uint32)
    for i in range(32):
        out[i // 8, (np.arange(256) >> (i % 8)) & 1 == 1] ^= images[i]
    return out


def _moved(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


@cache
def _byte_step() -> np.ndarray:
    """What the low byte of a CRC adds when a byte is taken in."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(_CRC_POLYNOMIAL), step >> 1).astype(np.uint32)
    return step


@cache
def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables that append m zero bytes: for each m below 64, and for m = 64, 128, 256, ... up to 2^31."""
    step = _byte_step()
    bits = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    images, small = bits, []
    for _ in range(64):
        small.append(_tables(images))
        images = (images >> 8) ^ step[images & 255]
    powers = [_tables(images)]
    while len(powers) < 26:
        images = _moved(powers[-1], images)
        powers.append(_tables(images))
    return np.stack(small), powers


def _appended(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC after ``size`` zero bytes more."""
    small, powers = _shifts()
    low = size & 63
    out = small[low, 0, crc & 255] ^ small[low, 1, (crc >> 8) & 255] ^ small[low, 2, (crc >> 16) & 255] ^ small[low, 3, crc >> 24]
    high, k = size >> 6, 0
    while len(high) and high.max() >> k:
        own = (high >> k) & 1 == 1
        out[own] = _moved(powers[k], out[own])
        k += 1
    return out


def _pieces(text: bytes, runs: int) -> Iterator[tuple[bytes, int]]:
    """A text in pieces, words parted by blanks, and how many words at a piece's start only lead on to the rest."""
    signs, at, lead = text.translate(_SIGNS), 0, []
    while at < len(signs):
        end = len(signs) if len(signs) - at <= PIECE else signs.find(b" ", at + PIECE)
        end = len(signs) if end < 0 else end
        piece = b" ".join([*lead, signs[at:end]])
        yield piece, len(lead)
        lead, at = (piece.split()[1 - runs:] if runs > 1 and end < len(signs) else []), end


def _words(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc, size, piece) of each word: one step a byte place, over the words that are long enough."""
    data = b" ".join(pieces) + b" "
    signs = np.frombuffer(data, np.uint8)
    edges = np.diff(np.concatenate(([0], (signs != 32).view(np.int8))))
    start = np.flatnonzero(edges == 1)
    size = np.flatnonzero(edges == -1) - start
    begin = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
    order = np.argsort(-size, kind="stable")
    first, step = start[order], _byte_step()
    sizes = -size[order]
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    for at in range(min(-int(sizes.min(initial=0)), LONG_WORD)):
        m = int(np.searchsorted(sizes, -at, "left"))  # words of more than ``at`` bytes
        crc[:m] = step[(crc[:m] ^ signs[first[:m] + at]) & 255] ^ (crc[:m] >> 8)
    crc = ~crc
    for i in range(int(np.searchsorted(sizes, -LONG_WORD, "left"))):
        crc[i] = zlib.crc32(data[first[i]:first[i] - int(sizes[i])])
    back = np.empty_like(crc)
    back[order] = crc
    return back, size, np.searchsorted(begin, start, "right") - 1


def _run_buckets(pieces: list[tuple[int, bytes, int]], runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of each run of words in the pieces (row, words, lead), a run counts where it ends; and the row of each word."""
    words_crc, words_size, piece = _words([w for _, w, _ in pieces])
    row = np.array([r for r, _, _ in pieces])[piece]
    n = np.bincount(piece, minlength=len(pieces))
    place = np.arange(len(piece)) - (np.cumsum(n) - n)[piece]
    own = place >= np.array([lead for _, _, lead in pieces])[piece]
    small = _shifts()[0]
    rows, out, crc = [row[own]], [words_crc[own] % buckets], words_crc
    for r in range(1, runs):
        led = np.concatenate((np.zeros(1, np.uint32), crc[:-1]))[:len(crc)]  # the run that ends one word earlier
        crc = _appended(_moved(small[1], led) ^ np.uint32(_BLANK), words_size) ^ words_crc
        full = own & (place >= r)
        rows.append(row[full])
        out.append(crc[full] % buckets)
    return np.concatenate(rows), np.concatenate(out), rows[0]


def counted(texts: pa.Array, runs: int = RUNS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(n_words, counts) of each text; counts has a row a text and a column a bucket."""
    n_words = np.zeros(len(texts), np.int64)
    counts = np.zeros((len(texts), buckets), np.uint32)
    held: list[tuple[int, bytes, int]] = []
    size = 0

    def settle():
        rows, hits, words = _run_buckets(held, runs, buckets)
        lo, hi = held[0][0], held[-1][0] + 1
        counts[lo:hi] += np.bincount((rows - lo) * buckets + hits, minlength=(hi - lo) * buckets).reshape(-1, buckets).astype(np.uint32)
        n_words[lo:hi] += np.bincount(words - lo, minlength=hi - lo)

    for i, text in enumerate(pc.fill_null(texts, "").cast(pa.binary())):
        for piece, lead in _pieces(text.as_py(), runs):
            held.append((i, piece, lead))
            size += len(piece)
            if size >= PIECE // 2 or i - held[0][0] >= 127:
                settle()
                held, size = [], 0
    if held:
        settle()
    return n_words, counts


def bucket_totals(docs: DataFrame, text: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket. At most ``buckets`` rows come back."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += counted(batch.column(0), runs, buckets)[1].sum(axis=0, dtype=np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in docs.select(text).mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: float = 1000.0) -> np.ndarray:
    """Integer gain of each bucket, with one feature more in each bucket of both sides."""
    s, t, m = int(corpus.sum()), int(target.sum()), len(corpus)
    share = [float(b + 1) * float(s + m) / (float(a + 1) * float(t + m)) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(scale * math.log(x)) for x in share], np.int64)


def _planes(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    padded = np.zeros((*packed.shape[:-1], -(-packed.shape[-1] // 8) * 8), np.uint8)
    padded[..., :packed.shape[-1]] = packed
    return padded.view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(planes, value of a bit): two's complement, the last plane is the sign."""
    width = max(int(np.abs(gain).max(initial=1)).bit_length(), 1) + 1
    value = np.int64(1) << np.arange(width, dtype=np.int64)
    planes = _planes(np.stack([((gain >> k) & 1).astype(np.uint8) for k in range(width)]))
    value[-1] = -value[-1]
    return planes, value


def sliced_weights(counts: np.ndarray, planes: np.ndarray, value: np.ndarray, rows: int = 64) -> np.ndarray:
    """Sum of count times gain of each row of ``counts``, from bit planes."""
    out = np.zeros(len(counts), np.int64)
    most = counts.max(axis=1, initial=0)
    j = 0
    while len(most) and int(most.max()) >> j:
        tall = np.flatnonzero(most >> np.uint32(j))  # rows that still have a bit in this plane or above
        for at in range(0, len(tall), rows):
            own = tall[at:at + rows]
            bits = _planes(((counts[own] >> np.uint32(j)) & 1).astype(np.uint8))
            both = np.bitwise_count(bits[:, None, :] & planes[None, :, :]).sum(axis=2, dtype=np.int64)
            out[own] += (both @ value) << j
        j += 1
    return out


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", runs: int = RUNS) -> DataFrame:
    """key, n_words, n_features, weight of every row."""
    planes, value = gain_planes(gain)
    buckets, kind = len(gain), docs.schema[key].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, counts = counted(batch.column(1), runs, buckets)
            n_features = sum(np.maximum(n_words - r, 0) for r in range(runs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(sliced_weights(counts, planes, value))],
                                             ["key", "n_words", "n_features", "weight"])

    return docs.select(key, text).mapInArrow(weigh, f"key {kind}, n_words long, n_features long, weight long").withColumnRenamed("key", key)


def gumbel(key: Column, seed: int = 42, scale: float = 1000.0) -> Column:
    """Scaled Gumbel draw of a key, as an integer."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-scale) * F.ln(-F.ln(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, least_words: int = 20,
             seed: int = 42) -> DataFrame:
    """key, n_words, n_features, weight, score, rank of every row: ``percent`` of the rows of at least ``least_words`` words are drawn, best score first."""
    gain = gains(bucket_totals(docs, text), bucket_totals(target, target_text))
    rows = weighed(docs, gain, key, text).withColumnRenamed(key, "_key").withColumn("score", F.col("weight") + gumbel(F.col("_key"), seed))
    rows = pin(rows.withColumn("_stored", F.monotonically_increasing_id()))
    fit = rows.where(F.col("n_words") >= least_words)
    most = fit.count() * percent // 100
    order = [F.desc("score"), F.asc("_key"), F.asc("_stored")]
    ranged = fit.repartitionByRange(*order).sortWithinPartitions(*order)
    # the identifier counts the rows of a sorted partition in its low 33 bits
    ranged = pin(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before = running_offsets(ranged.groupBy("_part").agg(F.count("*").alias("_n")), "_part", "_n", "_before")
    rank = F.col("_before") + F.col("_at") + 1
    placed = ranged.join(F.broadcast(before), "_part").withColumn("rank", F.when(rank <= most, rank))  # one row a partition is sent
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    names = ["_key", "n_words", "n_features", "weight", "score", "rank"]
    return placed.select(names).unionByName(rest.select(names)).withColumnRenamed("_key", key)
