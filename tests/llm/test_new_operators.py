"""Line dedup, conversation prefix trie and structure repair against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rosterkit.llm import lines, structure, trie

CONV = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"


# -- 11 line dedup ------------------------------------------------------------------

def _lines_brute(docs, min_chars, min_docs):
    held = defaultdict(set)
    key = lambda x: x.strip(SPACE).encode().lower().decode()
    rank = lambda d: -(1 << 70) if d is None else d
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(rank(d))
    out = []
    for d, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(held[key(x)]) < min_docs or rank(d) == max(held[key(x)])]
        out.append((d, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("min_chars,min_docs", [(40, 5), (10, 2)])
def test_line_dedup_equals_brute_force(spark, min_chars, min_docs):
    r = random.Random(5)
    pool = ["É" * 40, "é" * 40, "The quick brown Fox jumps over the lazy dog again", "the QUICK brown fox jumps over the lazy dog again",
            "x" * 39, " " * 60, "y" * 40, " " + "z" * 39, "short", "", "日本" * 20, "a line that only three documents hold, so it has to stay"]
    docs = [(i, "\n".join(r.choice(["", " ", "\t", "\r"]) + r.choice(pool) + r.choice(["", "  ", "\r", "\x0b"]) for _ in range(r.randrange(9))))
            for i in range(60)]
    docs += [(None, pool[2] + "\n" + pool[3]), (None, pool[2]), (7, pool[2]), (7, docs[7][1]), (99, None), (98, ""), (97, "\n\n"), (1000, pool[2] + "\n" + pool[2])]
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id long, text string, kept string").repartition(4)
    got = lines.dedup(df, min_chars, min_docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"]
    rows = got.collect()
    assert Counter(tuple(x)[:4] for x in rows) == _lines_brute(docs, min_chars, min_docs)
    assert all(hashlib.sha256(x.kept.encode()).hexdigest() == x.kept_sha256 for x in rows)


def test_line_dedup_many_shards_and_full_filters(spark, monkeypatch):
    """Shards of few hashes, and filters so full that nearly every line is suspected: the result is the same."""
    r = random.Random(6)
    docs = [(i, "\n".join(f"{r.randrange(60):03d} is a line of more than forty code points, surely" for _ in range(8))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(lines, "SHARD_KEYS", 10)
    want = _lines_brute(docs, 40, 5)
    assert Counter(tuple(x)[:4] for x in lines.dedup(df, with_text=False).collect()) == want
    assert sum(x[2] * n for x, n in want.items()) > 300
    f = lines.TwoFilters(4, 1)
    f.add(np.arange(50, dtype=np.uint64), np.zeros(50, bool))
    f.add(np.arange(3, dtype=np.uint64), np.zeros(3, bool))
    assert f.repeated(np.arange(3, dtype=np.uint64)).all()   # false repeats may occur, missed ones never
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- 12 prefix trie --------------------------------------------------------------------

def _trie_brute(rows):
    held = defaultdict(list)
    for c, n, role, text in rows:
        held[c].append(((n is not None, n or 0), role or "", text or ""))
    seqs = {c: [(a, b) for _, a, b in sorted(v)] for c, v in held.items()}
    built = {}
    for c, own in seqs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        built[c] = own if c is None or c % 5 == 0 else seqs.get(c - c % 5, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    ids = lambda v: sorted(x for x in v if x is not None)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    least = lambda p: min(ids(members[p]), default=None)
    return Counter((least(p), len(p), least(p[:-1]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ids(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def _conversations(seed, n=60):
    r, rows = random.Random(seed), []
    texts = ["", "hi", "Hällo", "a b c", "x" * 50, None]
    for c in range(n):
        if r.random() < 0.1:
            continue
        rows += [(c, k, r.choice(["user", "assistant", "system", None]) if r.random() < 0.1 else ["user", "assistant"][k % 2], r.choice(texts) if r.random() < 0.4 else "hi")
                 for k in range(r.randrange(1, 14))]
    base = [(k, "user", f"t{k}") for k in range(40)]
    rows += [(200 + 5 * i, k, a, b) for i in range(12) for k, a, b in base[:3 * i + 1]]        # each the start of the next
    rows += [(400 + 5 * i, 0, "system", "same") for i in range(9)]                             # equal ones
    rows += [(None, 3, "user", "n"), (None, None, "user", "m"), (501, 0, "user", "only turn, cut away"), (503, -1, "a", "b"), (504, None, "a", "b")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_nodes", [1, 3, 64, 1 << 16])
def test_trie_equals_brute_force(spark, shard_nodes):
    rows = _conversations(shard_nodes)
    df = spark.createDataFrame([(*x, 1) for x in rows], CONV + ", depth int").repartition(3)
    got = Counter(map(tuple, trie.prefix_trie(df, shard_nodes=shard_nodes).collect()))
    assert got == _trie_brute(rows)


def test_trie_repeated_rows_and_empty(spark):
    rows = [(0, 1, "user", "a"), (0, 1, "user", "a"), (0, 1, "user", "a"), (5, 1, "user", "a")]
    got = Counter(map(tuple, trie.prefix_trie(spark.createDataFrame(rows, CONV)).collect()))
    assert got == _trie_brute(rows) and max(x[1] for x in got) == 3
    assert trie.prefix_trie(spark.createDataFrame([], CONV)).count() == 0


def test_parens_find_subtrees():
    r = random.Random(1)
    for _ in range(60):
        n, d = r.choice([1, 2, 50, 700]), [r.randrange(5)]
        for _ in range(n - 1):
            d.append(r.choice([d[-1] + 1, d[-1], r.randrange(d[-1] + 2)]))
        p = trie.Parens(np.array(d, np.int64), None)
        close = p.findclose()
        for i in range(n):
            j = next((j for j in range(i + 1, n) if d[j] <= d[i]), None)
            assert (close[i] < 0) if j is None else (p.opened[close[i]] == j)


# -- 13 structure repair -----------------------------------------------------------------

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def _least(rows):
    """(cost, audit, repaired rows) over whole strings, by a plain search over states of the pattern."""
    best = {0: (0, "", ())}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for s, (cost, audit, done) in list(out.items()):
                for x, role in (("u", "user"), ("a", "assistant")):
                    t = STEP.get((s, x))
                    if t is not None:
                        out[t] = min(out.get(t, (10**9,)), (cost + 5, audit + "I", (*done, (role, ""))))
        return out

    for role, text, fault in rows:
        # every reading before the row, not only the least per state, as inserted rows may tie
        new = {}
        for s, (cost, audit, done) in best.items():
            for s2, (c2, a2, d2) in inserted({s: (cost, audit, done)}).items():
                ways = [(c2 + 2, a2 + "D", d2, s2)]
                if fault not in ("blank", "duplicate"):
                    stay = 5 if fault == "truncated" else 0
                    if (s2, role[:1]) in STEP:
                        ways.append((c2 + stay, a2 + "K", (*d2, (role, text)), STEP[s2, role[:1]]))
                    ways += [(c2 + 1 + stay, a2 + "R", (*d2, (full, text)), STEP[s2, x])
                             for x, full in (("u", "user"), ("a", "assistant")) if (s2, x) in STEP]
                for c3, a3, d3, s3 in ways:
                    new[s3] = min(new.get(s3, (10**9,)), (c3, a3, d3))
        best = new
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def _harmed(rows):
    held = defaultdict(list)
    for c, n, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
        new = ("user" if harm == 4 else role, "" if harm == 1 else "".join(x for x in text if x not in ".!?") if harm == 2 else text)
        held[c] += [((n is not None, n or 0, role, text, k), n, *new) for k in range({0: 0, 3: 2}.get(harm, 1))]
    return {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in held.items()}


def _repair_brute(rows):
    out = []
    for c, v in _harmed(rows).items():
        turns = [n for n, _, _ in v if n is not None]
        seen, marked = set(), []
        for _, role, text in v:
            t = text.rstrip(SPACE)
            fault = "blank" if not t else "duplicate" if (role, text) in seen else "" if t[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, done = _least(marked)
        n = Counter(f for *_, f in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{a}:{b}" for a, b in done).encode()).hexdigest()))
    return Counter(out)


def _messy(seed, n=40, longest=14):
    r, rows = random.Random(seed), []
    texts = ["Yes.", "no", "What?", "", " \t", "Go on! ", "a.b", "…", None, "Ok.\n", "fine. "]
    for c in range(n):
        rows += [(c, r.choice([k, k, k, k + 1, None]), r.choice(["user", "assistant", "system", "tool", "", None, "sys", "u"]), r.choice(texts)) for k in range(r.randrange(1, longest))]
    rows += [(None, k, "user", f"{k}.") for k in range(9)] + [(900 + k, 0, "user", "x.") for k in range(30)]
    rows += [(1000, k, ["user", "assistant"][k % 2], f"turn {k}.") for k in range(150)] + [(1001, 5, "user", "same.")] * 30
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment", [1, 7, 1024])
def test_repair_equals_brute_force(spark, segment):
    rows = _messy(segment)
    df = spark.createDataFrame([(*x, 1) for x in rows], CONV + ", audit int").repartition(3)
    got = Counter(map(tuple, structure.repair(df, segment=segment).collect()))
    assert got == _repair_brute(rows)


def test_least_cost_over_all_edits():
    """The parse against every string of edits of short conversations, tried one by one."""
    r = random.Random(3)
    for _ in range(60):
        rows = [(r.choice(["system", "user", "assistant", "tool"]), f"{k}", r.choice([0, 0, 0, 1, 2, 3])) for k in range(r.randrange(4))]
        found = []
        for audit in itertools.product(*[[p + e for p in ("", "I", "II") for e in "KRD"] for _ in rows], ("", "I", "II")):
            edits, k, states, cost, ok = "".join(audit), 0, {0}, 0, True
            for e in edits:
                if e == "D":
                    cost, k = cost + 2, k + 1
                    continue
                symbols = ("u", "a")
                if e == "I":
                    cost += 5
                else:
                    role, _, fault = rows[k]
                    ok &= fault not in (1, 2)
                    cost += (e == "R") + 5 * (fault == 3)
                    symbols = symbols if e == "R" else (role[:1],)
                    k += 1
                states = {STEP[s, x] for s in states for x in symbols if (s, x) in STEP}
            if ok and states & {0, 3}:
                found.append((cost, edits))
        p = structure.Parse(0)
        for role, _, fault in rows:
            p.row(role[:1], fault)
        cost, tail, top = structure.finish(p.live)
        assert (cost, "".join(p.audit(top)) + tail) == min(found), rows


def test_repair_of_nothing(spark):
    assert structure.repair(spark.createDataFrame([], CONV)).count() == 0
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = structure.repair(spark.createDataFrame([(c, 0, "user", "gone.")], CONV)).collect()
    assert [tuple(x) for x in got] == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
