"""Shuffle files and scratch tables go when nothing reads them any more; keys are sorted as by full sorts."""

from __future__ import annotations

import itertools
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from rosterkit import session  # noqa: E402
from rosterkit.llm import common, exchange, suffixes  # noqa: E402


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.name for d in dirs for f in Path(d.toString()).rglob("shuffle_*")}


def test_a_cut_leaves_no_shuffle_files(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(common.CLEANUP, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    t = common.cut(df, "sums")
    assert not _shuffle_files(spark) - before and spark.conf.get(common.CLEANUP, None) == setting
    assert t.count() == 7 and sorted(t.collect()) == sorted(df.collect()) == sorted(t.collect())


def test_suffix_searches_send_one_after_the_other(spark, monkeypatch):
    ask, asked = suffixes._ask_suffixes, []

    def recorded(*args):
        asked.append(ask(*args))
        return asked[-1]

    monkeypatch.setattr(suffixes, "_ask_suffixes", recorded)
    passage = " ".join(f"word{i}" for i in range(90))
    docs = spark.createDataFrame([(1, "a " + passage), (2, passage + " b"), (3, "c")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in suffixes.repeats(docs, 400, 51).collect()}
    assert [rows[i]["n_removed"] for i in (1, 2, 3)] == [len(passage), len(passage), 0]
    assert [rows[i]["n_repeat_words"] for i in (1, 2, 3)] == [90, 90, 0]
    n_parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [{r["part"] // n_parts for r in a.select("part").collect()} for a in asked] == [{0}, {1}]


def test_one_of_each_group_leaves_the_survivors_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda s: str(tmp_path))
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "a", 1), (2, text + " more", "en", "a", 1), (3, "other words than these", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert sorted({f.parent.name for f in tmp_path.rglob("part-*")}) == ["survivors"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_orders_of_keys_are_those_of_full_sorts():
    r = np.random.default_rng(1)
    for n, most in itertools.product((0, 1, 2, 50, 5000), (3, 1 << 61)):
        k = np.stack([r.integers(0, most, n, dtype=np.uint64), r.integers(0, 3, n, dtype=np.uint64)], axis=1)
        assert (k[exchange.pairs_in_order(k)] == k[np.lexsort((k[:, 1], k[:, 0]))]).all()
        d = np.unique(k, axis=0)
        for keys, n_parts in itertools.product((d, d[::-1], r.permutation(d)), (1, 7, 70_000)):
            order, part = exchange.pair_order(keys, n_parts)
            assert (order == np.lexsort((keys[:, 1], keys[:, 0], part))).all()
