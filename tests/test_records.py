"""Quoted fields with line breaks at split borders, and inferred column types."""

from __future__ import annotations

import csv
import datetime as dt
import io
import random

import pytest

from rosterkit.sources import files
from rosterkit.sources.types import merge_types


def _csv(rows, end="\n"):
    f = io.StringIO()
    csv.writer(f, lineterminator=end).writerows(rows)
    return f.getvalue()


def _rows(seed, n):
    r = random.Random(seed)
    pieces = ["a", "b c", ",", '"', "\n", "\n\n", "é", "x" * 30, "1", "\nq,"]
    return [[f"k{seed}-{i}", "v" + "".join(r.choice(pieces) for _ in range(r.randrange(9))) + "v", str(i)] for i in range(n)]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", n), spark.conf.set("spark.sql.files.openCostInBytes", 1))
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("split,end", [(40, "\n"), (64, "\r\n"), (1000, "\n"), (1 << 20, "\r\n")])
def test_line_breaks_in_quotes_at_split_borders(spark, tmp_path, small_splits, split, end):
    want = []
    for k, n in enumerate((40, 1, 25)):
        rows = _rows(k, n)
        want += rows
        (tmp_path / f"f{k}.csv").write_bytes(("It's a report\nsecond\n" + _csv([["key", "text", "n"], *rows], end)).encode())
    # a record over many splits, and a file without a line break in any field
    (tmp_path / "g.csv").write_bytes(("x\ny\n" + _csv([["n", "key", "text"], ["1", "long", "v" + "\n" * 300 + "v"], ["2", "after", "plain"]], end)).encode())
    want += [["long", "v" + "\n" * 300 + "v", "1"], ["after", "plain", "2"]]
    small_splits(split)
    df = files.read_many(spark, [f"{tmp_path}/*.csv"], skip=2, multiline=True, keep_source=False)
    assert df.columns == ["key", "text", "n"]   # of the first file by path; g.csv has another order
    got = sorted(tuple(x) for x in df.collect())
    # the csv parser gives every line break in a field as a line feed
    assert got == sorted((k, t, n) for k, t, n in want)


def test_a_header_beyond_the_first_split_raises(spark, tmp_path, small_splits):
    (tmp_path / "f.csv").write_text("a long preamble line\n" + _csv([["key", "text"], ["1", "2"]]))
    (tmp_path / "g.csv").write_text("p\n" + _csv([["key", "text"], ["1", "2"]]))
    (tmp_path / "only.csv").write_text("p\n")
    assert files.read_many(spark, [f"{tmp_path}/*.csv"], skip=1).count() == 2
    small_splits(7)
    with pytest.raises(Exception, match="do not fit the first split"):
        files.read_many(spark, [f"{tmp_path}/*.csv"], skip=1).collect()


def test_without_few_splits_lines_are_sorted(spark, tmp_path, small_splits, monkeypatch):
    rows = _rows(9, 60)
    (tmp_path / "f.csv").write_text(_csv([["key", "text", "n"], *rows]))
    small_splits(20)
    monkeypatch.setattr(files, "BROADCAST_FILES", 0)
    df = files.read_many(spark, [f"{tmp_path}/*.csv"], multiline=True, keep_source=False)
    assert sorted(tuple(x) for x in df.collect()) == sorted(map(tuple, rows))


def test_broken_quotes_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    with pytest.raises(Exception, match="multiline=True"):
        files.read_many(spark, [f"{tmp_path}/a.csv"]).collect()
    assert [tuple(x) for x in files.read_many(spark, [f"{tmp_path}/a.csv"], multiline=True, keep_source=False).collect()] == [("1", "x\ny"), ("2", "z")]
    (tmp_path / "b.csv").write_text('a,b\n1,"x\ny\n2,z\n')
    with pytest.raises(ValueError, match="not balanced"):
        files.read_many(spark, [f"{tmp_path}/b.csv"], multiline=True)
    (tmp_path / "c.csv").write_text('a,"b\n1",2\n')
    with pytest.raises(ValueError, match="header line"):
        files.read_many(spark, [f"{tmp_path}/c.csv"], multiline=True)


def test_a_record_without_end_raises(spark, tmp_path, small_splits):
    from pyspark.sql import functions as F

    from rosterkit.sources import records
    (tmp_path / "a.csv").write_text('a,b\n1,"' + "x\n" * 500 + '"\n2,z\n')
    small_splits(100)
    lines = files._lines(spark, [f"{tmp_path}/a.csv"], "\n").where("value <> 'a,b'").select("_file", "_block", "_at", "value")
    heads = lines.select("_file").distinct().withColumn("_header", F.lit("a,b"))
    with pytest.raises(Exception, match="more than 400 characters"):
        records.records(lines, heads, max_chars=400).collect()
    assert records.records(lines, heads, max_chars=2000).count() == 2


def test_types_over_all_files(spark, tmp_path):
    head = ["e", "l", "i", "d", "day", "code", "big", "mixed", "late"]
    first = [["", "T", "1", "1.5", "2017-01-31", "007", "9" * 25, "T", "5"], ["NA", "FALSE", "-20", "3", "2017/2/1", "12", "1", "1", "6"]]
    (tmp_path / "a.csv").write_text(_csv([head, *first]))
    (tmp_path / "b.csv").write_text(_csv([head, ["", "F", "+3", "1e-3", "NA", "1", "2", "", "7"]]))
    paths = [f"{tmp_path}/*.csv"]
    df = files.read_many(spark, paths, types="infer", keep_source=False)
    assert dict(df.dtypes) == dict(e="string", l="boolean", i="bigint", d="double", day="date", code="string", big="double", mixed="string", late="bigint")
    rows = {x["i"]: x for x in df.collect()}
    assert rows[1]["day"] == dt.date(2017, 1, 31) and rows[-20]["day"] == dt.date(2017, 2, 1) and rows[3]["day"] is None
    assert rows[1]["l"] is True and rows[3]["d"] == 0.001 and rows[1]["code"] == "007"
    # only the last file breaks a type
    (tmp_path / "c.csv").write_text(_csv([head, ["", "F", "4", "5", "2017-02-30", "1", "3", "x", "7.25"]]))
    df = files.read_many(spark, paths, types="infer", keep_source=False)
    assert dict(df.dtypes)["day"] == "string" and dict(df.dtypes)["late"] == "double"
    (tmp_path / "d.csv").write_text(_csv([head, ["", "yes", "4", "5", "", "1", "3", "x", "many"]]))
    df = files.read_many(spark, paths, types="infer", keep_source=False)
    assert dict(df.dtypes)["l"] == "string" and dict(df.dtypes)["late"] == "string" and dict(df.dtypes)["i"] == "bigint"
    with pytest.raises(ValueError, match="types is"):
        files.read_many(spark, paths, types="guess")


def test_missing_values_break_no_type(spark):
    from rosterkit.sources.types import infer_types
    df = spark.createDataFrame([("1", "2017-01-31", "T", None), (None, None, None, None)], "i string, day string, l string, e string")
    assert infer_types(df) == {"i": "integer", "day": "date", "l": "logical", "e": "empty"}


def test_types_merge_as_a_lattice():
    kinds = ["empty", "logical", "integer", "double", "date", "text"]
    for a in kinds:
        assert merge_types(a, a) == a and merge_types(a, "text") == "text" and merge_types("empty", a) == a
        for b in kinds:
            assert merge_types(a, b) == merge_types(b, a)
            for c in kinds:
                assert merge_types(merge_types(a, b), c) == merge_types(a, merge_types(b, c))
