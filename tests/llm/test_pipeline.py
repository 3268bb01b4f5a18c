"""The registered queries and the pipeline on the smallest test data."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from rosterkit.llm import suffixes  # noqa: E402
from rosterkit.llm.queries import REGISTRY  # noqa: E402
from .brute import DOCS  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "suffix_dedup", "mixing", "bpe"]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.cut(stage(spark, docs, SF), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
        if name in ("toxicity", "jaccard_join", "suffix_dedup"):
            assert 0.7 * before <= docs.count() <= before
            assert docs.select("doc_id").distinct().count() == docs.count()
    assert docs.where("not round_trip").count() == 0 and docs.count() > 0


def test_native_operators_run_no_python(spark):
    for name in ("op9_quality", "op10_fingerprint"):
        plan = REGISTRY[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_oracle_sql(spark):
    import duckdb
    from rosterkit.llm.queries import ORACLE
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in ORACLE.items():
        df = REGISTRY[name](spark, SF)
        cur = con.execute(sql)
        assert df.columns == [c[0] for c in cur.description], name
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(cur.fetchall(), key=repr), name


def small_words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 3))) for _ in range(n))


def test_repeats_of_over_50_words_are_cut_whatever_their_bytes(spark):
    passage, shorter = small_words(1, 51), small_words(2, 50)
    assert len(passage) < 400
    texts = [f"{small_words(10 + k, 60)} {p} {small_words(20 + k, 60)}" for k, p in enumerate((passage, passage, shorter, shorter))]
    texts.append(f"{small_words(30, 60)} " + passage.replace(" ", "\n "))
    texts += [small_words(31, 20), None, ""]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS).repartition(3)
    got = {x.doc_id: x for x in corpus_pipeline.remove_repeats(spark, docs, SF).collect()}
    want = [t and t.replace(passage, "") for t in texts[:4]] + [f"{small_words(30, 60)} ", texts[5], None, ""]
    assert [got[k].text for k in range(8)] == want
    assert [got[k].n_chars for k in range(8)] == [len(t or "") for t in want]


def test_repeated_words_as_by_brute_force(spark):
    r = random.Random(5)
    parts = [small_words(k, r.randint(8, 20)) for k in range(12)]
    texts = [r.choice([" ", "\n", " \t"]).join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(30)]
    for length in (5, 13, 30):
        count = Counter(tuple(w[i:i + length]) for w in map(str.split, texts) for i in range(len(w) - length + 1))
        whole = Counter(texts)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        got = {x.doc_id: x for x in suffixes.dedup(docs, length, True, "words").collect()}
        for k, t in enumerate(texts):
            at = [m.span() for m in re.finditer(r"\S+", t)]
            gone = set()
            for i in range(len(at) - length + 1):
                if count[tuple(t[a:z] for a, z in at[i:i + length])] > 1:
                    gone.update(range(at[i][0], at[i + length - 1][1]))
            if whole[t] > 1 and len(at) >= length:
                gone = set(range(len(t)))
            assert bytes(got[k].kept).decode() == "".join(c for i, c in enumerate(t) if i not in gone), (length, k)


def test_repeats_are_cut_row_by_row(spark):
    passage = small_words(1, 60)
    own = [small_words(100 + k, 70) for k in range(9)]
    rows = [(7, f"{own[0]} {passage}", "en", "a", 1), (7, own[1], "de", "b", 2), (7, f"{passage} {own[2]}", None, "c", 3)]
    rows += [(None, f"{own[3]} {passage}", "en", "d", 4), (None, own[4], "fr", "e", 5), (None, f"{own[5]} {passage}", "es", None, 6)]
    rows += [(None, None, "en", "f", None), (None, "", "en", "g", 0), (8, own[6], "en", "h", 9)]
    got = corpus_pipeline.remove_repeats(spark, spark.createDataFrame(rows, DOCS).repartition(3), SF)
    assert got.columns == corpus_pipeline.COLUMNS
    cut = lambda t: t and t.replace(passage, "")
    want = [(d, cut(t), lang, s, n if cut(t) == t else len(cut(t))) for d, t, lang, s, n in rows]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_repeats_of_one_hot_id_stay_one_row_each(spark):
    passage = small_words(1, 60)
    rows = [(None if k % 3 else 5, f"{small_words(1000 + k, 30)} l{k} {passage} r{k} {small_words(3000 + k, 30)}", "en", f"s{k}", 1) for k in range(300)]
    got = corpus_pipeline.remove_repeats(spark, spark.createDataFrame(rows, DOCS).repartition(4), SF)
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == Counter((d, t.replace(passage, ""), s) for d, t, _, s, _ in rows)


def test_suffix_dedup_passes_clashing_columns_on(spark):
    rows = [(1, "a b c d e", 10, 1.5), (2, "x", 20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long, kept double")
    got = suffixes.dedup(df, 3, True, "words", ["n_bytes", "kept"])
    assert sorted((r.doc_id, r.n_bytes, r.n_bytes_in, r.kept_in) for r in got.collect()) == [(1, 9, 10, 1.5), (2, 1, 20, None)]


def test_one_row_of_each_group_stays(spark):
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(8)]
    near = lambda k: texts[k].rsplit(" ", 1)[0] + " other"
    rows = [(3, texts[0]), (None, texts[0]), (None, near(0)),            # copies of an id's text, without an id
            (None, texts[1]),                                             # alone, without an id
            (None, texts[2]), (None, near(2)),                            # a group without any id
            (1, texts[3]), (1, near(4)), (0, texts[4]),                   # id 1: least of its group, and a near copy of 0
            (4, texts[5]), (4, near(5)), (4, texts[5]),                   # a group of one id
            (2, texts[6]), (9, near(6)), (None, None), (None, ""), (None, ""), (6, " "), (6, None), (6, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS).repartition(3)
    got = corpus_pipeline.one_of_each_group(spark, docs, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    kept = Counter((x.doc_id, x.text) for x in got.collect())
    either = [k for k in (Counter([(None, texts[2])]), Counter([(None, near(2))])) if not k - kept]
    same = [k for k in (Counter([(4, texts[5])]), Counter([(4, near(5))])) if not k - kept]
    assert len(either) == 1 and len(same) == 1
    assert kept - either[0] - same[0] == Counter([(3, texts[0]), (None, texts[1]), (1, texts[3]), (0, texts[4]), (2, texts[6]),
                                                  (None, None), (None, ""), (6, " "), (6, None)])
