"""Vector bin packing of token sequences: each takes pieces under limits on tokens, segments and loss-bearing tokens.

A document is cut into pieces that fill a sequence alone and a rest. Rests wait in a pool of bounded size; a sequence is
filled by taking, again and again, the rest whose demand has the largest dot product with the room that is left, each
dimension measured against its limit. When no rest fits and ``least_piece`` tokens or more are free, the largest rest is
cut to fill them. Each task packs the rows it reads, so nothing is shuffled; only the last sequences of a task are short.

Defined results: null text is empty and has the end id alone; an empty table packs nothing; equal rows are packed one by
one; nulls in the key are carried along; texts of any length are cut. Extra columns are not read. Sequence ids hold the
task's number, so a repeated task gives the same rows; read the input from stored files, whose splits do not change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, gathered, vocabulary

END_ID = 2
#: Rests that wait in a task, and those left when packing pauses to read on, so that choices stay wide.
POOL, POOL_LOW = 2048, 512
BATCH_IDS = 4_000_000


class Packer:
    """Packs pieces of one task. A piece is (tag, start, ids as bytes, tokens of its document, loss-bearing ids)."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, least_piece: int, first_id: int):
        self.limit = np.array([max_tokens, max_segments, max_loss], np.float64)
        self.max_tokens, self.max_loss, self.least_piece, self.next_id = max_tokens, max_loss, least_piece, first_id
        self.pool: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, tag, ids: np.ndarray, loss: int | None) -> None:
        """Cut a document. Its last ``loss`` ids bear loss; None: all do."""
        n = len(ids)
        bearing = 0 if loss is None else max(0, n - loss)
        start = 0
        while start < n:
            end = min(start + self.max_tokens, n, max(start, bearing) + self.max_loss)
            piece = (tag, start, ids[start:end], n, max(0, end - max(start, bearing)))
            if end - start == self.max_tokens:
                self._close([piece])
            else:
                self.pool.append((tag, start, ids[start:end].copy(), n, piece[4]))
            start = end
        if len(self.pool) >= POOL:
            self.pack(POOL_LOW)

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for p in pieces:
            self.out.append((*p, self.next_id, offset))
            offset += len(p[2])
        self.next_id += 1

    def pack(self, leave: int = 0) -> None:
        """Fill sequences until at most ``leave`` rests wait."""
        pool = self.pool
        need = np.array([[len(p[2]), 1, p[4]] for p in pool], np.float64).reshape(-1, 3)
        waits = np.ones(len(pool), bool)
        left = len(pool)
        while left > leave:
            room, taken = self.limit.copy(), []
            while left:
                fits = waits & (need <= room).all(axis=1)
                if fits.any():
                    gain = np.where(fits, need @ (room / self.limit**2), -1.0)
                    i = int(gain.argmax())
                    taken.append(pool[i])
                    room -= need[i]
                    waits[i] = False
                    left -= 1
                elif room[0] >= self.least_piece and room[1] >= 1 and room[2] >= self.least_piece:
                    i = int(np.where(waits, need[:, 0], -1.0).argmax())
                    tag, start, ids, n, loss = pool[i]
                    cut = int(min(room[0], room[2], len(ids) - 1))
                    ahead = len(ids) - loss  # ids of the piece before those that bear loss
                    taken.append((tag, start, ids[:cut], n, max(0, cut - ahead)))
                    pool[i] = (tag, start + cut, ids[cut:], n, min(loss, len(ids) - cut))
                    need[i] = [len(ids) - cut, 1, pool[i][4]]
                    break
                else:
                    break
            self._close(taken)
        self.pool = [p for p, w in zip(pool, waits, strict=True) if w]

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", loss: str | None = None, max_tokens: int = 4096,
                   max_segments: int = 512, max_loss: int = 4096, least_piece: int = 32, vocabulary_path: str | None = None,
                   end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, loss_tokens, sequence_id, offset and the ids as little-endian
    unsigned 32-bit bytes. ``loss`` names a column with how many of a document's last ids bear loss (null or none: all).
    """
    path = vocabulary_path or vocabulary()
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(loss) if loss else F.lit(None)).cast("long").alias("loss"))
    names = [key, "start", "length", "doc_tokens", "loss_tokens", "sequence_id", "offset", "ids"]

    def table(pieces: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        tags, starts, ids, totals, losses, sequences, offsets = zip(*pieces, strict=True)
        sizes = [len(x) for x in ids]
        numbers = [pa.array(x, pa.int64()) for x in (starts, sizes, totals, losses, sequences, offsets)]
        return pa.RecordBatch.from_arrays([pa.array(tags, key_type), *numbers, pa.array([x.tobytes() for x in ids], pa.binary())], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, key_type, held = encoder(path), Packer(max_tokens, max_segments, max_loss, least_piece, TaskContext.get().partitionId() << 33), None, 0
        for batch in gathered(batches, 1):
            key_type = batch.column(0).type
            bounds, ids = encode.encode(batch.column(1), end_id)
            for tag, lost, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                packer.add(tag, ids[a:b], lost)
            held += len(ids)
            if held >= BATCH_IDS and packer.out:
                yield table(packer.drain(), key_type)
                held = 0
        packer.pack()
        if packer.out:
            yield table(packer.drain(), key_type)

    return rows.mapInArrow(pack, f"`{key}` {kind}, start long, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids binary")
