"""Polynomial fingerprints of byte ranges and sliding extremes, vectorised over a whole text.

Fingerprints are sums modulo 2^64, under which some long strings are known to collide (those of Thue and Morse, from 1,024 bytes). So
ranges of more than ``STURDY`` bytes are told apart by another hash wherever equality counts; for anchors, which only say
what is compared, fingerprints of any range will do.
"""

from __future__ import annotations

import numpy as np

#: Bytes up to which equal fingerprints may stand for equal ranges.
STURDY = 64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: An odd 64-bit code for each byte.
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up.size < n:
            n = max(n, 1 << 16)
            cls.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
            cls.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE, np.uint64)]))
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """What fingerprints of any range of raw (uint8) come from; one entry more than raw."""
    _, down = _Powers.upto(raw.size + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[raw] * down[: raw.size])])


def fingerprints(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of ranges [lo, hi), alike for equal bytes wherever they stand."""
    up, _ = _Powers.upto(int(lo.max(initial=0)) + 1)
    return mix((sums[hi] - sums[lo]) * up[lo] + (hi - lo).astype(np.uint64))


def slide(a: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op (minimum or maximum) over each window of so many entries, in time that doesn't depend on the width."""
    n = a.size
    info = np.iinfo(a.dtype)
    padded = np.concatenate([a, np.full(-n % width, info.max if op is np.minimum else info.min, a.dtype)]).reshape(-1, width)
    before = op.accumulate(padded, axis=1).ravel()
    after = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(after[: n - width + 1], before[width - 1 : n])
