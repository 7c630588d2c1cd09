"""Word-shingle sets of whole texts as 64-bit hashes, in numpy.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z.  Word hashes come from
one running polynomial over a block's bytes, so no word is made into a Python
object.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    folded = np.arange(256, dtype=np.uint64)
    folded[65:91] += np.uint64(32)
    return mix(folded + np.uint64(0x51ED2701))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            run = np.full(max(n, PIECE + 1), b, np.uint64)
            run[0] = 1
            _powers[i] = np.cumprod(run)
    return _powers[0], _powers[1]


def _hash_piece(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a piece of bytes and the words' starts; ``bounds``: where texts begin, within it."""
    n = len(data)
    up, down = _power(n + 1)
    space = _SPACE[data]
    begins = ~space
    ends = begins.copy()
    begins[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    begins[inner] |= ~space[inner]
    ends[inner - 1] |= ~space[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[:n], out=run[1:])
    return mix((run[last] - run[first]) * down[first]), first


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string array, and the index in them at which each text's words begin (one more than texts); null: no words."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] and len(texts) else np.zeros(0, np.uint8)
    found, starts, at = [], [], int(offsets[0])
    end = int(offsets[-1])
    while at < end:
        to = min(end, at + PIECE)
        if to < end:  # cut at a text's end or at white space
            k = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:
                back = np.flatnonzero(_SPACE[data[at:to]])
                to = at + int(back[-1]) + 1 if len(back) else int(offsets[k + 1])
        lo, hi = np.searchsorted(offsets, [at, to])
        h, s = _hash_piece(data[at:to], offsets[lo : hi + 1] - at)
        found.append(h)
        starts.append(s + at)
        at = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; a text with fewer words has its whole sequence as one, one without words has none."""
    words, begins = word_hashes(texts)
    n = max(len(words) - k + 1, 0)
    run = words[:n].copy()
    for j in range(1, k):
        run = mix(run * np.uint64(_BASE) + words[j : j + n])
    out = []
    for lo, hi in zip(begins[:-1], begins[1:], strict=True):
        if hi - lo >= k:
            out.append(np.unique(run[lo : hi - k + 1]))
        elif hi > lo:
            h = words[lo : lo + 1].copy()
            for j in range(lo + 1, hi):
                h = mix(h * np.uint64(_BASE) + words[j : j + 1])
            out.append(mix(h + np.uint64(int(hi - lo))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
