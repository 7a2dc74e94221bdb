"""The portable draws of ``core`` for many keys at once, in numpy.

MD5 is computed for all keys together, a word of the state an array: its 64 steps are then a few hundred array operations
instead of a call and a string a key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2.0**32).astype(np.uint32)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Keys hashed together: their state stays in the processor's cache.
_TOGETHER = 8192


def _first_words(words: np.ndarray) -> np.ndarray:
    """First 32 bits of the MD5 of padded messages as a big-endian number; ``words`` has a row a word, 16 a block."""
    width = words.shape[1]
    state = [np.full(width, s, np.uint32) for s in _START]
    f, t = np.empty(width, np.uint32), np.empty(width, np.uint32)
    for block in range(0, len(words), 16):
        a, b, c, d = (s.copy() for s in state)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
                place = i
            elif i < 32:
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
                place = (5 * i + 1) % 16
            elif i < 48:
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
                place = (3 * i + 5) % 16
            else:
                np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
                place = 7 * i % 16
            f += a
            f += words[block + place]
            f += _SINES[i]
            np.left_shift(f, np.uint32(_SHIFTS[i]), out=t)
            np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=f)
            f |= t
            f += b
            # the old a is free and serves as the next work space
            a, b, c, d, f = d, f, b, c, a
        for s, v in zip(state, (a, b, c, d), strict=True):
            s += v
    return state[0].byteswap()


def _bytes(texts: Sequence[bytes], start: int, width: int) -> np.ndarray:
    """Texts as rows of ``width`` bytes, each from ``start`` on, zero elsewhere."""
    return np.frombuffer(b"".join(t.rjust(start + len(t), b"\0").ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)


def portable_uniforms(seeds: Sequence[int], ids: Sequence[str], names: Sequence[str]) -> np.ndarray:
    """``core.portable_uniform`` of (seed, id, name) for all of each: an array (id, seed, name)."""
    heads = [(i, s, f"{seed}|{text}|".encode()) for i, text in enumerate(ids) for s, seed in enumerate(seeds)]
    tails = [n.encode() + b"\x80" for n in names]
    by_width: dict[int, list[tuple]] = {}
    for h in heads:
        by_width.setdefault(len(h[2]), []).append(h)
    messages: dict[int, list[tuple]] = {}
    for start, own in by_width.items():
        # a mark and a length of eight bytes stand behind a key; a word is that of its head, of its tail, or of both
        blocks = np.array([(start + len(t) + 8 + 63) // 64 for t in tails])
        for size in set(blocks.tolist()):
            some = np.flatnonzero(blocks == size)
            tail = _bytes([tails[n] for n in some], start, 64 * size).view("<u4").T.copy()
            tail[-2] = [8 * (start + len(tails[n]) - 1) for n in some]
            head = _bytes([h[2] for h in own], 0, 64 * size).view("<u4").T
            places = (np.array([h[0] * len(seeds) + h[1] for h in own])[:, None] * len(names) + some).ravel()
            messages.setdefault(size, []).append((places, (head[:, :, None] | tail[:, None]).reshape(16 * size, -1)))
    out = np.empty(len(heads) * len(names))
    for parts in messages.values():
        places, words = np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts], axis=1)
        for i in range(0, len(places), _TOGETHER):
            out[places[i:i + _TOGETHER]] = _first_words(words[:, i:i + _TOGETHER]) / 4294967296.0
    return out.reshape(len(ids), len(seeds), len(names))


def portable_normals(seeds: Sequence[int], ids: Sequence[str], names: Sequence[str]) -> np.ndarray:
    """``core.portable_normal`` of (seed, id, name) for all of each: an array (id, seed, name)."""
    u = portable_uniforms(seeds, ids, [f"{n}|{part}" for part in "ab" for n in names])
    first, second = np.maximum(u[..., :len(names)], 1.0 / 4294967296.0), u[..., len(names):]
    return np.sqrt(-2.0 * np.log(first)) * np.cos(6.283185307179586 * second)
