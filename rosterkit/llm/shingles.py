"""Word shingles of whole texts as sorted arrays of 64-bit hashes (in tasks)."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased, in order."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; fewer words: the whole sequence is one; none: empty."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = _mix(h * _MIX + w[k:len(w) - n + 1 + k])
    return np.unique(h)


def signature(s: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()
