"""Vectorised hashes of byte n-grams and words; small numpy helpers inside tasks."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the information of 64-bit values over all their bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hash(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of ``codes[i:i+k]`` for every i, by doubling."""
    if len(codes) < k:
        return np.zeros(0, dtype=np.uint64)
    power = mix(codes.astype(np.uint64) + np.uint64(1))
    size, done, out = 1, 0, None
    while True:
        if k & size:
            if out is None:
                out, done = power, size
            else:  # what is done so far, then the next ``size`` codes
                n = len(codes) - done - size + 1
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + power[done:done + n]
                done += size
        if done == k:
            return mix(out)
        n = len(power) - size
        power = power[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + power[size:size + n]
        size *= 2


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every window of ``w`` values (prefix and suffix minima of blocks)."""
    n = len(x)
    if n < w:
        return np.zeros(0, dtype=x.dtype)
    fill = np.full(-n % w, np.iinfo(x.dtype).max, dtype=x.dtype)
    blocks = np.concatenate([x, fill]).reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - w + 1], before[w - 1:n])


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 4096), _BASE, dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word between ASCII white space."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]]).view(np.int8)))
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of every word between ASCII white space, A-Z taken as a-z."""
    starts, _ = word_bounds(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(~_SPACE[data])
    codes = data[at]
    codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint64) + np.uint64(1)
    first = np.searchsorted(at, starts)
    sizes = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    return mix(np.add.reduceat(codes * _powers(int(sizes.max()))[place], first) + sizes.astype(np.uint64))


def shingles(data: np.ndarray, k: int = 5) -> np.ndarray:
    """Distinct hashes of k-word shingles, sorted; fewer words: the sequence as one."""
    words = word_hashes(data)
    if not len(words):
        return words
    return np.unique(gram_hash(words, min(k, len(words))))
