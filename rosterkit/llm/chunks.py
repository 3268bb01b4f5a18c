"""Encoding whole texts through a memo of the matches of a split pattern.

Every match of the pattern is encoded by itself, so equal matches have equal ids.
All matches of a slice of texts that the memo lacks go to the library in one call.
A worker keeps one memo per vocabulary, bounded in bytes; when it is full it
starts anew, which costs time and never changes an id.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate, chain, compress, pairwise
from operator import not_

import regex

MEMO_BYTES = 96 << 20   # memory of all remembered matches of a worker
ENTRY_BYTES = 180       # what an entry takes besides its characters and ids
LATIN = 0x250           # texts of characters below this are split by the standard library's engine, which is faster
CLASSES = (r"\p{L}", r"\p{N}", r"\s", r"\S")


def latin_pattern(pattern: str) -> re.Pattern:
    """The pattern for texts of characters below LATIN: its classes spelled out, as the regex library has them."""
    for c in CLASSES:
        found = [i for i in range(LATIN) if regex.match(c, chr(i))]
        spelled = "".join(f"\\u{i:04x}" for i in found)
        # inside a class the members alone, outside a class of its own
        pattern = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(c, spelled), pattern).replace(c, f"[{spelled}]")
    return re.compile(pattern)


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit), equal to encoding every match of ``pattern`` by itself."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], pattern: str, memo_bytes: int = MEMO_BYTES):
        self.matches, self.latin = regex.compile(pattern).findall, latin_pattern(pattern).findall
        self.beyond = re.compile(f"[^\\x00-\\u{LATIN - 1:04x}]").search
        self.encode_many, self.limit = encode_many, memo_bytes
        self.memo: dict[str, bytes] = {}
        self.used = 0

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the library is called once at most."""
        if self.used > self.limit:
            self.memo, self.used = {}, 0
        found = [self.matches(t) if self.beyond(t) else self.latin(t) for t in texts]
        flat = list(chain.from_iterable(found))
        out = list(map(self.memo.get, flat))
        missing = list(compress(range(len(out)), map(not_, out)))   # no match is without ids
        if missing:
            new = list(dict.fromkeys([flat[i] for i in missing]))
            ids = self.encode_many(new)
            self.memo.update(zip(new, ids))
            self.used += ENTRY_BYTES * len(new) + sum(map(len, new)) + sum(map(len, ids))
            for i in missing:
                out[i] = self.memo[flat[i]]
        return [b"".join(out[i:j]) for i, j in pairwise(accumulate(map(len, found), initial=0))]


@lru_cache(maxsize=2)
def encoder(library: Callable[[str], Callable[[list[str]], list[bytes]]], path: str, pattern: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return Encoder(library(path), pattern)


def slices(texts: list[str], size: int = 1_000_000):
    """Cut a list of texts into ranges of about ``size`` characters."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
