"""Token ids with the tokenizers library.

The public vocabulary drops white space and its pre-tokenizer never joins text across an ASCII blank, so a text's ids
are those of its blank-separated chunks in order. A batch's distinct chunks are looked up once; each Python worker keeps
the ids of chunks it has seen, up to ``MOST_CHUNKS``, and encodes those beyond anew, with the same result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from struct import pack
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_CHUNKS = 1_000_000
#: Text that is encoded at a time.
BATCH_BYTES = 8 << 20
#: Marks that never join a letter before them, so that a chunk may be cut ahead of a closing run of them.
CLOSING = ".,;:!?"

_encoders: dict[str, Encoder] = {}


def vocabulary() -> str:
    """Path of the default vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str | None = None) -> Encoder:
    """The encoder of this Python worker for a vocabulary file."""
    path = path or vocabulary()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts reach BATCH_BYTES: the more text, the fewer lookups a word."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= BATCH_BYTES:
            yield _one(held)
            held, size = [], 0
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)], batches[0].schema.names)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids of chunks as little-endian unsigned 32-bit bytes; a chunk that is not held is encoded when asked for."""

    def __init__(self, path: str):
        super().__init__({"": b""})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids): text i has ids[bounds[i]:bounds[i + 1]]; null is empty; ``end_id`` closes each text when given."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = np.asarray(lists.offsets).astype(np.int64)
        bounds -= bounds[0]
        coded = lists.flatten().dictionary_encode()
        which = np.asarray(coded.indices).astype(np.int64)
        blobs = list(map(self.__getitem__, coded.dictionary.to_pylist()))
        if end_id is not None:
            which = np.insert(which, bounds[1:], len(blobs))
            bounds = bounds + np.arange(len(bounds))
            blobs.append(pack("<I", end_id))
        pool = np.frombuffer(b"".join(blobs), "<u4")
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        first = np.cumsum(size) - size
        count = size[which]
        ends = np.concatenate(([0], np.cumsum(count)))
        at = np.repeat((first[which] - ends[:-1]).astype(np.int32), count)
        at += np.arange(ends[-1], dtype=np.int32)
        return ends[bounds], pool[at]

    def __missing__(self, chunk: str) -> bytes:
        body = chunk.rstrip(CLOSING)
        tail = chunk[len(body):]
        small = self._small(body)
        if small is None:
            ids, tail = self._packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids), ""
        elif small == chunk:
            ids = self._merged(chunk if chunk.isascii() else "".join(map(self.letters.__getitem__, chunk.encode("utf-8"))))
        else:
            ids = self[small]  # merged once for all spellings and closing marks of a word
        if tail:
            ids += self[tail]
        if len(self) < MOST_CHUNKS:
            self[chunk] = ids
        return ids

    @staticmethod
    def _small(body: str) -> str | None:
        """The run of small letters that the vocabulary makes of a run of letters; None where it may make something else of it."""
        if not body.isalpha():
            return None
        if body.isascii():
            return body.lower()
        small = "".join(c.lower() for c in body)
        return small if small.isalpha() and is_normalized("NFC", body) and is_normalized("NFC", small) and "".join(c.lower() for c in small) == small else None

    def _merged(self, run: str) -> bytes:
        """Ids of one run of letters, which the pre-tokenizer would hand to the merges as a whole."""
        return self._packed([t.id for t in self.merge(run)])

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return pack(f"<{len(ids)}I", *ids)
