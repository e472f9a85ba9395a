"""Keyed pseudorandom permutation of [0, n): balanced Feistel network with cycle-walking."""

from __future__ import annotations

import numpy as np

from .kernels import mix

ROUNDS = 6


def feistel(index: np.ndarray, n: int | np.ndarray, key: int | np.ndarray) -> np.ndarray:
    """Image of each index under the permutation of its domain; `n` and `key` may differ from row to row.

    The network permutes the smallest even-width power of two that holds the
    domain; an image outside is permuted again until it falls inside (at most
    four times the domain, so about four steps on average at worst).
    """
    index = np.asarray(index, np.uint64)
    n = np.broadcast_to(np.asarray(n, np.uint64), index.shape)
    key = np.broadcast_to(np.asarray(key, np.uint64), index.shape)
    half = np.ones(index.shape, np.uint64)
    for _ in range(32):
        half += ((np.uint64(1) << (half + half)) < n) & (half < 31)
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [mix(key + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % (1 << 64))) for r in range(ROUNDS)]
    out = index.copy()
    pending = np.arange(len(index))
    while len(pending):
        h, m = half[pending], mask[pending]
        left, right = out[pending] >> h, out[pending] & m
        for k in keys:
            left, right = right, left ^ (mix(right + k[pending]) & m)
        out[pending] = (left << h) | right
        pending = pending[out[pending] >= n[pending]]
    return out.astype(np.int64)
