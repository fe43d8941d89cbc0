"""Words and word n-grams of UTF-8 texts as 64-bit numbers, for many texts at a time."""

from __future__ import annotations

import numpy as np

NGRAM = 5
_TOKEN = np.zeros(256, bool)
_TOKEN[128:] = True
_TOKEN[ord("0") : ord("9") + 1] = True
_TOKEN[ord("a") : ord("z") + 1] = True
_TOKEN[ord("A") : ord("Z") + 1] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.empty(n, np.uint64)
    p = 1
    for i in range(n):
        out[i] = p
        p = p * base & _MASK
    return out


_POW = _powers(64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, first and end byte of each word. A word is a run of ASCII letters and digits and of bytes of other
    characters; texts should be in lower case already."""
    global _POW
    on = _TOKEN[data]
    if not len(data) or not on.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = on[:-1]
    inner = offsets[:-1]
    before[inner[inner < len(data)]] = False
    start = np.flatnonzero(on & ~before)
    at = np.flatnonzero(on)
    first = np.searchsorted(at, start)
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    longest = int(length.max())
    if longest > len(_POW):
        _POW = _powers(2 * longest)
    h = (data[at].astype(np.uint64) + np.uint64(1)) * _POW[place]
    h = mix(np.add.reduceat(h, first) + length.astype(np.uint64))
    return h, np.searchsorted(offsets, start, side="right") - 1, start, start + length


_STEP = [np.uint64(p) for p in _powers(64, 0xD6E8FEB86659FD93)]


def grams(h: np.ndarray, doc: np.ndarray, texts: int, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams in order of texts, and offsets by text. A text of 1 to n - 1 words has one gram, of all its words."""
    size = np.bincount(doc, minlength=texts)
    begin = np.cumsum(size) - size
    count = np.where(size >= n, size - n + 1, (size > 0).astype(size.dtype))
    offsets = np.concatenate([[0], np.cumsum(count)])
    nth = np.arange(offsets[-1]) - np.repeat(offsets[:-1], count)
    at = np.repeat(begin, count) + nth
    most = np.repeat(np.minimum(size, n), count)
    g = np.zeros(len(at), np.uint64)
    for j in range(n):
        ok = j < most
        if ok.all():
            g += h[at + j] * _STEP[j]
        else:
            g[ok] += h[at[ok] + j] * _STEP[j]
    return mix(g + most.astype(np.uint64)), offsets
