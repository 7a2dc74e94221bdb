"""Content-chosen anchors of byte strings: every string of ``LENGTH`` bytes holds one, wherever it occurs.

A gram of ``GRAM`` bytes is an anchor where its hash is least among the grams of some whole string of LENGTH bytes. Equal
strings have equal anchors, so a string that two documents share is found by an anchor that they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
#: Bytes hashed at a time, so that working arrays stay small whatever the length of a text.
BLOCK = 1 << 19

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_BYTES = (np.arange(1, 257, dtype=np.uint64) * _MIX[0]) ^ ((np.arange(1, 257, dtype=np.uint64) * _MIX[1]) >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of each gram of a byte array, by doubling 1, 2, 4, 8, 16 and adding the last four."""
    h1 = _BYTES[data]
    h2 = h1[:-1] * _MIX[1] + h1[1:]
    h4 = h2[:-2] * _MIX[2] + h2[2:]
    h8 = h4[:-4] * _MIX[3] + h4[4:]
    h16 = h8[:-8] * _MIX[4] + h8[8:]
    h = h16[:-4] * _MIX[5] + h4[16:]
    h ^= h >> np.uint64(31)
    h *= _MIX[2]
    h ^= h >> np.uint64(29)
    return h


def _sliding(x: np.ndarray, pick) -> np.ndarray:
    """pick over each run of SPAN = 31 entries."""
    for step in (1, 2, 4, 8):
        x = pick(x[:-step], x[step:])
    return pick(x[:-15], x[15:])


def find(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of documents data[bounds[i]:bounds[i + 1]], in order."""
    places, hashes = [], []
    n = len(data)
    begin = np.zeros(n, bool)  # where a whole string of LENGTH bytes begins inside one document
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        begin[a:max(a, b - LENGTH + 1)] = True
    for lo in range(0, n - LENGTH + 1, BLOCK):
        hi = min(lo + BLOCK, n - LENGTH + 1)
        if not begin[lo:hi].any():
            continue
        h = gram_hashes(data[lo:hi + LENGTH - 1])  # grams lo .. hi + SPAN - 2
        least = np.where(begin[lo:hi], _sliding(h, np.minimum), np.uint64(0))
        pad = np.zeros(SPAN - 1, np.uint64)
        most = _sliding(np.concatenate((pad, least, pad)), np.maximum)
        at = np.flatnonzero(most == h)
        places.append(at + lo)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def chunks(batches: Iterator, most: int = 1 << 20) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(rows, data, bounds): rows of (tag, text) gathered to about ``most`` bytes; null text is empty."""
    rows, parts, size = [], [], 0
    for tag, text in batches:
        b = (text or "").encode("utf-8", "replace")
        rows.append(tag)
        parts.append(b)
        size += len(b)
        if size >= most:
            yield rows, *_joined(parts)
            rows, parts, size = [], [], 0
    if rows:
        yield rows, *_joined(parts)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
