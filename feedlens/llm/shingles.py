"""Sets of word shingles as sorted 64-bit hashes, computed on whole Arrow buffers."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]                       # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _BACK)):
            p = np.full(n + 1 + (n >> 2), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n + 1], _powers[1][:n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the texts' words). Words are what white space of
    ASCII parts; A-Z count as a-z."""
    n = len(buf)
    space = _SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[docs] = True
    after = np.ones(n, bool)
    after[1:] = space[:-1]
    first = np.flatnonzero(~space & (after | edge[:n]))
    before = np.ones(n, bool)
    before[:-1] = space[1:]
    last = np.flatnonzero(~space & (before | edge[1:])) + 1
    up, back = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:n], out=sums[1:])
    return mix((sums[last] - sums[first]) * back[first]), np.searchsorted(first, docs)


def shingle_sets(buf: np.ndarray, docs: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text in a row, offsets). A text of fewer
    than ``words`` words has its whole sequence as its one shingle."""
    word, off = word_hashes(buf, docs)
    count = np.diff(off)
    total = len(word)
    if total >= words:
        every = word[:total - words + 1] * _PLACE[0]
        for j in range(1, words):
            every = every + word[j:total - words + 1 + j] * _PLACE[j]
        every = mix(every)
    else:
        every = np.zeros(0, np.uint64)
    sets, size = [], np.zeros(len(count), np.int64)
    for d, n in enumerate(count.tolist()):
        if n >= words:
            own = np.sort(every[off[d]:off[d] + n - words + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            own = mix((word[off[d]:off[d + 1]] * _PLACE[:n]).sum(keepdims=True) + _PLACE[words + n])
        else:
            continue
        sets.append(own)
        size[d] = len(own)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(size)])


def set_keys(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One 64-bit key per set (0 for an empty one)."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ _BASE))])
    key = mix(sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(np.uint64) * _PLACE[63])
    return np.where(np.diff(off) > 0, key, 0)
