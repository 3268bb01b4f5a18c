"""Arithmetic modulo the prime 2**61 - 1 on arrays, for names of sequences.

A sequence x is named by the sum of x[i] * base**i.  Two different sequences of
length n share a name for at most n - 1 of the 2**61 - 1 bases.
"""

from __future__ import annotations

import numpy as np

PRIME = (1 << 61) - 1
_P, _61 = np.uint64(PRIME), np.uint64(61)


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, from 32-bit halves."""
    low, s32, s29 = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(29)
    ah, al, bh, bl = a >> s32, a & low, b >> s32, b & low
    mid, small = ah * bl + al * bh, al * bl
    x = (ah * bh << np.uint64(3)) + (mid >> s29) + ((mid & np.uint64((1 << 29) - 1)) << s32) + (small & _P) + (small >> _61)
    return _reduce(x)


def powmod(base: int, exponent: np.ndarray) -> np.ndarray:
    out, square, e = np.ones(len(exponent), np.uint64), base % PRIME, exponent.astype(np.uint64)
    while len(e) and e.max():
        out = np.where(e & np.uint64(1), mulmod(out, np.full(len(e), square, np.uint64)), out)
        square, e = square * square % PRIME, e >> np.uint64(1)
    return out


def running(x: np.ndarray, before: int) -> np.ndarray:
    """Running sums modulo 2**61 - 1, from ``before`` on (halves are added up apart, so nothing overflows)."""
    hi, lo = np.cumsum(x >> np.uint64(31)), np.cumsum(x & np.uint64((1 << 31) - 1))
    total = mulmod(_reduce(hi), np.full(len(x), 1 << 31, np.uint64)) + _reduce(lo)
    return _reduce(_reduce(total) + np.uint64(before))


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... (``n`` of them), by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, mulmod(out, np.full(len(out), pow(base, len(out), PRIME), np.uint64))])
    return out[:n]


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b modulo 2**61 - 1, of residues."""
    return _reduce(a + _P - b)
