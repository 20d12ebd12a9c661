"""Word shingles as 64-bit hashes, and minimum-hash sketches of shingle sets."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import CACHE_ENTRIES

#: Positions of a sketch.
WIDTH = 128
_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, WIDTH, dtype=np.uint64)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_WORDS: dict[str, int] = {}


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``n`` lower-case words (split at white space).

    A text of fewer words, but at least one, has the single shingle of all its words.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _WORDS
    if len(known) > CACHE_ENTRIES:
        known.clear()
    try:
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode())
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ ids[k : len(words) - n + 1 + k]) * _STEP
        h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return np.unique(h)


def forget_words() -> None:
    """Give back the memory of remembered words."""
    _WORDS.clear()


def sketch(own: np.ndarray) -> np.ndarray:
    """Minimum hashes of a set, 16 bits of each; two sets agree at a position with their Jaccard similarity."""
    low = np.full(WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 4096):
        part = (own[None, i : i + 4096] * _MULTIPLY[:, None] + _ADD[:, None]).min(1)
        np.minimum(low, part, out=low)
    low ^= low >> np.uint64(31)
    low *= _MIX
    return (low >> np.uint64(48)).astype(np.uint16)


def pair_counts(left: list[np.ndarray], right: list[np.ndarray], split: int = 64) -> np.ndarray:
    """Sizes of the intersections of every left with every right set (sorted, distinct values).

    Shingles that up to ``split`` right sets hold are counted pair by pair, the others by products.
    """
    m, k = len(left), len(right)
    out = np.zeros((m, k), np.float32)
    if not (m and k):
        return out
    l_owner, r_owner = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    l_value, r_value = np.concatenate(left), np.concatenate(right)
    order = np.argsort(r_value, kind="stable")
    r_owner, r_value = r_owner[order], r_value[order]
    low, high = np.searchsorted(r_value, l_value, "left"), np.searchsorted(r_value, l_value, "right")
    held = high - low
    few = np.flatnonzero((held > 0) & (held <= split))
    step = 4_000_000 // split
    for a in range(0, len(few), step):
        at = few[a : a + step]
        n = held[at]
        ends = np.cumsum(n)
        there = np.repeat(low[at] - (ends - n), n) + np.arange(ends[-1])
        out += np.bincount(np.repeat(l_owner[at] * k, n) + r_owner[there], minlength=m * k).reshape(m, k)
    many = np.flatnonzero(held > split)
    starts, number = np.unique(low[many], return_inverse=True)
    for a in range(0, len(starts), 2048):
        width = min(2048, len(starts) - a)
        own = (number >= a) & (number < a + width)
        x, y = np.zeros((m, width), np.float32), np.zeros((k, width), np.float32)
        x[l_owner[many[own]], number[own] - a] = 1
        for c, begin in enumerate(starts[a : a + width].tolist()):
            y[r_owner[begin : np.searchsorted(r_value, r_value[begin], "right")], c] = 1
        out += x @ y.T
    return out
