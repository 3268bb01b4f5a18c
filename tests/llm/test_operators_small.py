"""Every operator against brute force on a small table with odd rows, and on an empty one."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

tokenizers_files = pytest.importorskip("public_tokenizers")

from rosterkit.llm import (bpe, chunks, exchange, fingerprints, hmm, jaccard, mixing, quality, residues, roles, suffixes,  # noqa: E402
                           token_files, toxicity)
from . import brute  # noqa: E402

ROWS = brute.odd_documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, brute.DOCS).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.DOCS)


@pytest.fixture(autouse=True)
def few_starting_rounds(monkeypatch):
    monkeypatch.setattr(hmm, "START_ROUNDS", 20)   # enough for small tables


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


# -- 1 mixing ---------------------------------------------------------------

def test_targets_fill_up_to_the_cap():
    t = mixing.fill_targets([100, 100, 1000], [5, 2, 1], 1800, 2)
    assert t[:2] == [200, 200] and abs(t[2] - 1400) < 1e-9
    assert mixing.fill_targets([10, 0], [1, 5], 15, 2) == [15.0, 0.0]


def test_tree_splits_every_draw_once():
    quota = np.array([17, 0, 230, 4])
    got = list(mixing.leaves(0, 13, quota, np.zeros(4, dtype=np.int64), 3))
    assert [s for s, _, _ in got] == list(range(13))
    assert (sum(n for _, n, _ in got) == quota).all()
    for a, b in zip(got, got[1:]):
        assert (a[2] + a[1] == b[2]).all()
    sizes = [int(n.sum()) for _, n, _ in got]
    assert max(sizes) - min(sizes) <= 2


def test_mix_meets_targets(docs):
    m = mixing.mix(docs.withColumnRenamed("n_chars", "size"), block_words=300, shard_words=2000)
    p = m.toPandas()
    assert "size_in" in p and len(p) == len(ROWS)
    assert p["size"].tolist() == [len(brute.words(t)) for t in p.text]
    for _, g in p.groupby("source", dropna=False):
        assert g["size"].sum() == g.source_size.iloc[0]
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
    assert (p.taken <= 2 * p["size"]).all()
    again = mixing.mix(docs.withColumnRenamed("n_chars", "size"), block_words=300, shard_words=2000)
    assert rows_of(m, "doc_id", "taken") == rows_of(again, "doc_id", "taken")
    s = mixing.shards(m).toPandas()
    assert s.words.sum() == p.taken.sum() and s.shard.nunique() > 3


def test_mix_empty(empty):
    assert mixing.mix(empty).count() == 0


# -- 2 roles ----------------------------------------------------------------

def cheapest(turns):
    def insert(b):
        for _ in range(4):
            for x, c in list(b.items()):
                for y in roles.LEGAL[x]:
                    b[y] = min(b.get(y, math.inf), c + roles.INSERT)
        return b

    best = {0: 0.0}
    for t in turns:
        st, new = roles.role_state(t), {}
        for x, c in insert(best).items():
            for y in roles.LEGAL[x]:
                new[y] = min(new.get(y, math.inf), c + roles.RELABEL * (y != st))
            if x:
                new[x] = min(new.get(x, math.inf), c + roles.MERGE + roles.RELABEL * (x != st))
        best = new
    return insert(best)[3]


def test_role_repair(spark, monkeypatch):
    monkeypatch.setattr(roles, "SEGMENT", 8)
    monkeypatch.setattr(roles, "SUPER", 3)
    r = random.Random(2)
    rows = [(None if c == 4 else c, None if c == 3 and t > 2 else t, r.choice(["user", "assistant", "system", " User", "tool", None]),
             r.choice(["hi", "", None, "x\ny"]), "extra") for c in range(25) for t in range(200 if c == 0 else r.randint(1, 12))]
    p = roles.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")).toPandas()
    assert len(p) == len(rows)
    for _, g in p.groupby("conv_id", dropna=False):
        g = g.sort_values(["segment", "place"])
        text = "".join(g.piece)
        got = re.findall(r"<\|(system|user|assistant)\|>\n", text)
        states = [0, *map(roles.ROLES.index, got)]
        assert all(b in roles.LEGAL[a] for a, b in zip(states, states[1:])) and got[-1] == "assistant"
        assert text.count(roles.CLOSE) == len(got) and text.endswith(roles.CLOSE)
        assert abs(g.cost.sum() - cheapest(g.role)) < 1e-9
    assert roles.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# -- 3 suffix dedup -----------------------------------------------------------

def test_difference_cover():
    v, cover = suffixes.difference_cover()
    assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and v < suffixes.LENGTH


@pytest.mark.parametrize("with_text", [False, True])
def test_suffix_dedup(spark, with_text):
    r = random.Random(3)
    say = lambda n: "".join(r.choice("ab cdé\n") for _ in range(n))
    p, q = say(450), say(1200)
    texts = [None, "", p[:399], p, "x" + p + "y", p + p, q, q, q[:600] + "!" + q[600:], "a" * 1000, "a" * 399, "a" * 400,
             say(3000) + q[200:800] + say(10), "ab" * 700, *[t for _, t, *_ in ROWS]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x for x in suffixes.dedup(df, 400, with_text).collect()}
    for i, b in enumerate(brute.repeats(texts, 400)):
        x = got[i]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == b
        assert not with_text or hashlib.sha256(x.kept).hexdigest() == b[3]


def test_suffix_dedup_empty(empty):
    assert suffixes.dedup(empty).count() == 0


# -- 4 toxicity ---------------------------------------------------------------

def test_toxicity_held_out(spark):
    r = random.Random(4)
    plain, bad = [f"word{i}" for i in range(300)], ["vile", "nasty", "awful"]
    rows, labels = [], []
    for i in range(900):
        y = i % 5 == 0
        w = [r.choice(plain) for _ in range(r.randint(5, 60))]
        if y:
            w[r.randrange(len(w))] = r.choice(bad).upper() + "!"
        # a group that is named more often in toxic texts
        if r.random() < (0.6 if y else 0.1):
            w.append("women.")
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    docs = spark.createDataFrame([*rows, (None, None), (5000, ""), (5001, "women are here"), (5002, "men are here")], "doc_id long, text string")
    m = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int"))
    s = {x.doc_id: x for x in toxicity.score(docs.withColumn("score", docs.doc_id), m).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(s[i].predicted == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert s[None].score == s[5000].score and 0 <= s[5000].score < 0.5
    assert s[5001].predicted == 0 and abs(s[5001].score - s[5002].score) < 0.1
    assert s[5].score_in == 5


def test_toxicity_without_labels(spark, empty):
    m = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert m.words == {} and toxicity.score(empty, m).count() == 0


def test_identity_swaps():
    out = toxicity.swaps("Nothing here. The Muslim man; and a jew.\nplain")
    assert out == [(frozenset({b"muslim", b"man"}), frozenset({b"christian", b"woman"})), (frozenset({b"muslim"}), frozenset({b"jewish"}))]


# -- 5 and 6 encoders -----------------------------------------------------------

ODD = ["", "  ", " a", "a ", "a\n\nb", "a \nb", "don't, isn't.  x  y", "x.́, y", "123,456 7.8!?", "\t\ttab\r\n x", "é" * 50 + " ñ",
       " <|endoftext|> hi", "a'. 'b ',", "日本語 テキスト。 x", "👩‍👩‍👧 ok", "ab\u0085 c", "'s 't 're,", "Of.\nThe.", "x" * 5000]


@pytest.fixture(scope="module")
def libraries():
    import base64

    import tiktoken
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizers_files.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers_files.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=tokenizers_files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return (lambda x: t.encode(x, add_special_tokens=False).ids), e.encode_ordinary


def test_encoders_equal_the_libraries(libraries):
    texts = [*ODD, *[t or "" for _, t, *_ in ROWS], "".join(map(chr, range(0x300))), *[f"a{chr(c)}1 {chr(c)}b" for c in range(0x300)]]
    for kind, path, want in ((token_files.library, "byte_bpe_50k.json", libraries[0]), (bpe.library, "byte_bpe_50k.tiktoken", libraries[1])):
        one, calls = kind(tokenizers_files.path(path)), []
        enc = chunks.Encoder(lambda x: calls.append(len(x)) or one(x), tokenizers_files.PATTERN, memo_bytes=20_000)
        n = 0
        for _ in range(2):
            for i, j in chunks.slices(texts, 500):
                n += 1
                for t, got in zip(texts[i:j], enc.batch(texts[i:j])):
                    assert np.frombuffer(got, "<u4").tolist() == want(t), t
                assert len(enc.memo) * chunks.ENTRY_BYTES < 2_000_000
        assert len(calls) <= n  # one library call a slice, not one a word


def test_token_files(spark, docs, libraries):
    files = token_files.write_and_read(docs, tokenizers_files.path("byte_bpe_50k.json"), tokenizers_files.PATTERN)
    got = token_files.digests(files).toPandas().sort_values("start", kind="stable")
    assert len(got) == len(ROWS)
    assert got.start.tolist() == [0, *got.n_tokens.cumsum().tolist()[:-1]]
    ids = got.doc_id[got.doc_id.notna()].tolist()
    assert ids == sorted(ids) and got.doc_id.isna().tolist()[:2] == [True, True]
    want = Counter((d, len(i) + 1, zlib.crc32(np.array([*i, 2], "<u4").tobytes())) for d, t, *_ in ROWS for i in (libraries[0](t or ""),))
    assert Counter((None if d != d else int(d), n, c) for d, n, c in zip(got.doc_id, got.n_tokens, got.ids_crc32)) == want
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in files.where("doc_id = 7")._jdf.queryExecution().toString()


def test_token_files_map_added_tokens_as_the_unmodified_library_does(spark):
    from tokenizers import Tokenizer
    path, end = tokenizers_files.path("byte_bpe_50k.json"), "<|endoftext|>"
    t = Tokenizer.from_file(path)
    texts = [f"a {end} b", end, end + end, f"in{end}side it's", f"x\n{end}\n y  z", f" {end}", f"{end} ", "a <|endoftext |> b", "<|endoftext|", "plain text",
             None, "", f"don't, {end}, x ." * 40, "<|ENDOFTEXT|>", "end <| endoftext|>"]
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    files = token_files.write_and_read(df, path, tokenizers_files.PATTERN)
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    assert [x.ids for x in files.orderBy("doc_id").collect()] == want
    got = token_files.digests(files).orderBy("doc_id").collect()
    assert [x.n_tokens for x in got] == [len(x) for x in want]
    assert [x.start for x in got] == [sum(map(len, want[:k])) for k in range(len(want))]
    assert [x.ids_crc32 for x in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]


def test_bpe_round_trip(docs, libraries):
    out = bpe.encode_decode(docs.withColumnRenamed("n_chars", "ids"), tokenizers_files.path("byte_bpe_50k.tiktoken"), tokenizers_files.PATTERN)
    got = out.collect()
    assert len(got) == len(ROWS) and "ids_in" in out.columns
    for x in got:
        assert bytes(x.decoded) == x.text.encode() and np.frombuffer(x.ids, "<u4").tolist() == libraries[1](x.text) and x.n_tokens * 4 == len(x.ids)


def test_encoders_empty(empty):
    path, pattern = tokenizers_files.path, tokenizers_files.PATTERN
    assert token_files.digests(token_files.write_and_read(empty, path("byte_bpe_50k.json"), pattern)).count() == 0
    assert bpe.encode_decode(empty, path("byte_bpe_50k.tiktoken"), pattern).count() == 0


# -- 7 Jaccard join -------------------------------------------------------------

@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_near_duplicates(docs, size, percent):
    got = rows_of(jaccard.near_duplicates(docs, size, percent), "doc_id", "n_shingles", "component_id")
    want = sorted(((d[0], *c) for d, c in zip(ROWS, brute.components(ROWS, size, percent))), key=repr)
    assert got == want


def test_near_duplicates_of_one_origin(spark):
    """Copies with a few edits each: most pairs are below the threshold, links run through the least edited."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(150)] = f"e{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = rows_of(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 90),
                  "doc_id", "n_shingles", "component_id")
    assert got == sorted(((d[0], *c) for d, c in zip(rows, brute.components(rows, 3, 90))), key=repr)


def test_near_duplicates_empty(empty):
    assert jaccard.near_duplicates(empty).count() == 0


def test_components_of_a_long_path(spark):
    n = 200
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {x.node: x.root for x in exchange.components(e, "path").collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


# -- 8 language model -------------------------------------------------------------

def test_forward_equals_all_paths():
    m = hmm.Model.first(np.full(5, 0.2), 3)
    classes, sizes = np.array([0, 1, 4, 2, 2, 3]), np.array([2, 4])

    def paths(c):
        return sum(math.prod([m.start[p[0]] * m.emit[c[0], p[0]]] + [m.move[p[i - 1], p[i]] * m.emit[c[i], p[i]] for i in range(1, len(c))])
                   for p in itertools.product(range(3), repeat=len(c)))

    assert np.allclose(hmm.forward(m, classes, sizes), [math.log10(paths(classes[:2])), math.log10(paths(classes[2:]))])
    start, move, emit = hmm.expected(m, classes, sizes)
    assert np.isclose(start.sum(), 2) and np.isclose(move.sum(), 4) and np.allclose(emit.sum(1), np.bincount(classes, minlength=5))


def test_rounds_raise_the_likelihood():
    r = np.random.default_rng(1)
    sizes = np.full(30, 20)
    classes = np.concatenate([r.integers(0, 5, 20) + 5 * (k % 2) for k in range(30)])
    shares = np.full(10, 0.1)
    m, last = hmm.Model.first(shares, 2), -np.inf
    for _ in range(6):
        now = hmm.forward(m, classes, sizes).sum()
        assert now >= last - 0.5
        last, m = now, hmm.Model.refit(*hmm.expected(m, classes, sizes), shares)
    assert hmm.forward(m, classes, sizes).mean() > 20 * math.log10(0.1) + 4


def test_language_model(docs):
    got = hmm.hmm_scores(docs).collect()
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, (_, t, *_) in enumerate(ROWS)}
    held = [zlib.crc32(str("" if d is None else d).encode()) % 7 == 2 for d, *_ in ROWS]
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted(((d, h, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6))
                   for (d, *_), h, ws in zip(ROWS, held, tokens.values())), key=repr)
    assert sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got), key=repr) == want
    assert all(math.isfinite(x.score) and x.score < 0 for x in got)


def test_language_model_empty(empty):
    assert hmm.hmm_scores(empty).count() == 0


# -- 9 quality ----------------------------------------------------------------------

def test_quality_counts(docs):
    for x in quality.quality(docs.withColumnRenamed("n_chars", "kept")).collect():
        n = brute.quality_counts(x.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == n
        assert x.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (x.base_failed and x.kept)


def test_quality_rejects_outliers(spark):
    r = random.Random(9)
    say = lambda n: " ".join("x" * r.randint(2, 8) + str(r.randrange(999)) for _ in range(n))
    rows = [(i, say(int(math.exp(r.gauss(5, 0.7))) + 12), "en", f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, " ".join("###" + w + "&&" for w in say(100).split()), "en", "s0") for i in range(6)]
    got = {x.doc_id: x for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i].kept for i in range(6))
    assert sum(got[i].kept for i in range(300)) >= 297


def test_quality_empty(empty):
    assert quality.quality(empty).count() == 0


# -- 10 fingerprints -------------------------------------------------------------------

def test_fingerprints(docs):
    like = fingerprints.likeness
    e = fingerprints.edited(docs, range_rows=7)
    e = e.withColumn("near", like(e.fingerprint, e.edited_fingerprint)).withColumn("near_next", like(e.fingerprint, e.next_fingerprint))
    p = e.toPandas()
    assert len(p) == len(ROWS)
    assert p.groupby("text").fingerprint.nunique().max() == 1
    shingles = lambda t: ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in [t.encode().lower().split()])
    error = []
    for x in p.itertuples():
        third = len(x.text) // 3
        assert x.edited_text == x.text[:len(x.text) - third] + x.next_text[:third]
        a, b = next(shingles(x.text)), next(shingles(x.edited_text))
        error.append(abs(x.near - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert np.mean(error) < 0.06 and max(error) < 0.25
    # the order: ids descending, repeated ones side by side, null ids last
    seq = {(None if i != i else int(i), t): n for i, t, n in zip(p.doc_id, p.text, p.next_text)}
    by_id = sorted({d: t or "" for d, t, *_ in ROWS if d is not None}.items(), reverse=True)
    for (d, t), (_, n) in zip(by_id, by_id[1:]):
        if sum(x[0] == d for x in ROWS) == 1:
            assert seq[d, t] == n


def test_fingerprints_one_row_and_none(spark, empty):
    one = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    x = fingerprints.edited(one).first()
    assert x.next_text == x.text and len(x.fingerprint) == 256
    assert fingerprints.edited(empty).count() == 0


# -- names, layouts and limits ----------------------------------------------------

def test_repeats_of_words_beside_bytes(spark, monkeypatch):
    """51-word passages are reported beside the 400-byte ones; equal names of samples and words alone remove nothing."""
    passage = " ".join(f"w{k}" for k in range(51))                 # 51 words, far below 400 bytes
    long = " ".join(f"longword{k:04d}" for k in range(60))         # 60 words, above 400 bytes
    rows = [(1, f"one {passage} two"), (2, f"three  {passage}\nfour"), (3, f"five {long} six"), (4, f"{long}"), (5, "only here " * 3),
            (None, None), (None, ""), (6, f"copy {long}"), (6, f"copy {long}"), (7, " ".join(f"w{k}" for k in range(50)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def words(texts, n):
        data = [(t or "").encode().split() for t in texts]
        count = Counter(tuple(w[i:i + n]) for w in data for i in range(len(w) - n + 1))
        out = []
        for w in data:
            gone = [False] * len(w)
            for i in range(len(w) - n + 1):
                if count[tuple(w[i:i + n])] > 1:
                    gone[i:i + n] = [True] * n
            out.append((sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))))
        return out

    texts = [t for _, t in rows]
    want = Counter((d, *b, *w) for (d, _), b, w in zip(rows, brute.repeats(texts, 400), words(texts, 51)))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeat_words", "n_repeat_runs"]
    got = suffixes.repeats(df)
    assert got.columns == names and Counter(map(tuple, got.collect())) == want
    assert sum(w[0] == 51 for w in words(texts, 51)) == 2
    assert hashlib.sha256(b"").hexdigest() in {x[4] for x in want}


def test_equal_first_names_do_not_decide(monkeypatch):
    """Two windows that share the first part of their names, but not the second, are different."""
    x = np.frombuffer(b"abcdefghijklmnopqrst" * 3, np.uint8)
    u = suffixes.Units(x, np.array([len(x)]), "bytes")
    names, inverse, counts = u.distinct(np.arange(41), 20)
    assert len(names) == 20 and counts.tolist().count(2) + counts.tolist().count(3) == 20 and inverse[0] == inverse[20] == inverse[40]
    keys = np.array([[5, 1], [5, 2], [7, 1]], dtype=np.uint64)
    rows = exchange.ask_repeated_pairs(0, keys, np.array([1, 1, 2]), 4)
    table = pa.Table.from_batches([rows])
    reply = pa.table({"part": table.column("part"), "totals": table.column("counts")})
    assert exchange.collect_pairs(reply, keys, 4).tolist() == [False, False, True]


def test_names_modulo_a_prime():
    r = random.Random(2)
    p = residues.PRIME
    a, b = ([r.randrange(p) for _ in range(2000)] for _ in range(2))
    A, B = np.array(a, np.uint64), np.array(b, np.uint64)
    assert residues.mulmod(A, B).tolist() == [x * y % p for x, y in zip(a, b)]
    assert residues.minus(A, B).tolist() == [(x - y) % p for x, y in zip(a, b)]
    assert residues.powers(12345, 300).tolist() == [pow(12345, e, p) for e in range(300)] == residues.powmod(12345, np.arange(300)).tolist()
    total, want = 77, []
    for x in a:
        total = (total + x) % p
        want.append(total)
    assert residues.running(A, 77).tolist() == want


def test_hmm_scores_do_not_depend_on_files(spark):
    """Equal scores for two layouts of the same rows, and a better likelihood of unseen texts than word counts give."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a, b = (hmm.hmm_scores(d).toPandas().sort_values("doc_id") for d in (docs, docs.repartition(7)))
    assert np.allclose(a.score.values, b.score.values, rtol=0, atol=1e-9) and (a.base_score.values == b.base_score.values).all()
    held = a[a.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_unfinished_components_raise(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r.root for r in exchange.components(edges, "whole").collect()} == {0}
    monkeypatch.setattr(exchange, "MOST_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="still change"):
        exchange.components(edges, "short")


def test_shards_hold_equal_numbers_of_draws(spark, tmp_path, monkeypatch):
    """The splitting tree's leaves: every block draw lies in one shard, and shards differ by one draw at most."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    m = mixing.mix(docs, block_words=300, shard_words=4000).cache()
    rows = mixing.shards(m)
    n_shards = rows.agg(F.count_distinct("shard")).first()[0]
    per = {}
    for x in rows.select("shard", "pass", "doc_id", "words").collect():
        assert (x["pass"], x.doc_id) not in per      # a document is drawn once a pass, by one shard
        per[x["pass"], x.doc_id] = x.shard
    quota = [37, 5, 111]
    table = mixing.shard_quotas(spark, quota, 8, seed=3).collect()
    sizes = Counter()
    for x in table:
        sizes[x.shard] += x.n
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == sum(quota) and len(sizes) == 8
    for si, n in enumerate(quota):                   # disjoint ranges of every source's draws that cover them
        ranges = sorted((x["first"], x.n) for x in table if x.si == si)
        assert [a for a, _ in ranges] == list(itertools.accumulate((k for _, k in ranges[:-1]), initial=0)) and sum(k for _, k in ranges) == n
    path = mixing.write_shards(m, f"{tmp_path}/shards")
    back = spark.read.parquet(path)
    assert n_shards > 1 and back.count() == rows.count() and back.agg(F.count_distinct("shard")).first()[0] == n_shards


def test_role_repair_of_rows_without_numbers(spark, monkeypatch):
    """Null ids, null turns and one turn number for all: segments hold a bounded number of rows all the same."""
    monkeypatch.setattr(roles, "SEGMENT", 4)
    monkeypatch.setattr(roles, "SUPER", 2)
    rows = [(None, k, "user", f"n{k}") for k in range(30)] + [(1, None, "user" if k % 2 else "assistant", f"t{k:02d}") for k in range(30)]
    rows += [(2, 7, "user", "same")] * 30
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = roles.repair(df).toPandas()
    assert len(got) == 90 and got.groupby(["conv_id", "segment"], dropna=False).size().max() <= 4
    for c in (None, 1, 2):
        own = got[got.conv_id.isna() if c is None else got.conv_id == c].sort_values(["segment", "place"])
        assert own.turn.tolist() == list(range(30)) if c is None else own.turn.isna().all() if c == 1 else set(own.turn) == {7}
        assert abs(own.cost.sum() - cheapest(own.role)) < 1e-9


def test_the_penalty_lowers_false_positives_on_neutral_mentions(spark, monkeypatch):
    """Toxic training texts name one group far more often; neutral texts that name it score lower with the penalty."""
    r = random.Random(8)
    plain = [f"word{k}" for k in range(60)]
    say = lambda: " ".join(r.choice(plain) for _ in range(12))
    rows, labels = [], []
    for k in range(1200):
        toxic = k % 2
        named = r.random() < (0.8 if toxic else 0.05)
        insult = toxic and r.random() < 0.7
        other = plain[:1] if toxic else ["christian", "jewish", "hindu", plain[0]]   # other groups are named in harmless texts
        rows.append((k, f"{say()} {'muslim' if named else r.choice(other)} {say()} {'vermin scum' if insult else say()}."))
        labels.append((k, toxic))
    neutral = [(10_000 + k, f"{say()} muslim {say()}.") for k in range(100)]
    docs = spark.createDataFrame(rows + neutral, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    mean = {}
    for weight in (0.0, 1.0):
        monkeypatch.setattr(toxicity, "FAIRNESS", weight)
        s = {x.doc_id: x for x in toxicity.score(docs, toxicity.fit(docs, table)).collect()}
        mean[weight] = sum(s[d].score for d, _ in neutral) / len(neutral), sum(s[d].predicted for d, _ in neutral)
        insults = [d for d, t in rows if "vermin" in t]
        assert sum(s[d].predicted for d in insults) > 0.9 * len(insults)
    assert mean[1.0][0] < mean[0.0][0] - 0.05 and mean[1.0][1] <= mean[0.0][1]
