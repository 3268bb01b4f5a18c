"""Plain Python models that the operators are tested against, and a small table with odd rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().split()


def odd_documents(seed: int = 1):
    """Nulls, empty and blank texts, a long text, exact and near copies, ties, repeated rows, shared passages."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(160)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base, passage = say(220), say(140)
    texts = [None, "", "   \n\t ", "one", "One", "two words", say(6000), base, base, base + " x", "y " + base]
    for k in range(1, 8):
        w = base.split()
        for _ in range(k):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [say(r.randint(3, 90)) for _ in range(25)]
    texts += [say(30) + "\n" + passage + "\n" + say(20) for _ in range(4)]
    texts += ["same line\nsame line\n" + say(12), "a b c d e " * 9, "## && || %% " + say(20)]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", None]), len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[20], (None, say(15), "en", "s1", 5), (None, None, None, None, None)]


def components(docs, size, percent):
    """(n_shingles, component) per row, in order."""
    sets = []
    for _, t, *_ in docs:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(docs):
        if d[0] is not None:
            least[find(i)].append(d[0])
    return [(len(s), min(least[find(i)], default=None)) if s else (0, d[0]) for i, (s, d) in enumerate(zip(sets, docs))]


def repeats(texts, length):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) per text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def quality_counts(text):
    import re
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count, cover, seen, lines = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if count[x] > 1:
            cover.update(range(i, i + 5))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(cover)
