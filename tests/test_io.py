import os

from pyspark.sql import functions as F

from rosterkit.operators.schema import clean_names
from rosterkit.sources import files, sinks

PREAMBLE = ["Report: services", "Run by: batch", "", "x", "y", "z", "w"]


def _write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_read_many_skips_preamble_and_keeps_source(spark, tmp_path):
    d = tmp_path / "services"
    (d / "complete_years").mkdir(parents=True)
    _write(d / "complete_years" / "a.csv", PREAMBLE + ["MEDICAID ID,PROVIDER NAME,FROM DATE",
                                                       "ID-1,2-Lapeer,1/2/2017", '"ID-2","3-St, Clair",2017-1-3'])
    _write(d / "b.csv", PREAMBLE + ["MEDICAID ID,PROVIDER NAME,FROM DATE", "ID-3,4-Sanilac,1/4/2017"])
    df = files.read_many(spark, files.period_paths(str(d)), skip=7)
    assert df.columns == ["MEDICAID ID", "PROVIDER NAME", "FROM DATE", files.SOURCE_FILE]
    rows = {r["MEDICAID ID"]: r for r in df.collect()}
    assert set(rows) == {"ID-1", "ID-2", "ID-3"}
    assert rows["ID-2"]["PROVIDER NAME"] == "3-St, Clair"  # quoted separator
    audit = {os.path.basename(r[files.SOURCE_FILE]): r.rows for r in files.load_audit(df).collect()}
    assert audit == {"a.csv": 2, "b.csv": 1}
    assert clean_names(df.drop(files.SOURCE_FILE), "underscore").columns == ["MEDICAID_ID", "PROVIDER_NAME", "FROM_DATE"]


def test_read_many_dedupe_and_description_row(spark, tmp_path):
    d = tmp_path / "adm"
    d.mkdir()
    head = ["a", "b", "c"]
    _write(d / "1.csv", head + ["case number,medicaid id", "descr,descr", "1,0000000001", "2,0000000002"])
    _write(d / "2.csv", head + ["case number,medicaid id", "descr,descr", "1,0000000001"])
    df = files.read_many(spark, [str(d)], skip=3, dedupe=True, drop_rows_after_header=1)
    assert sorted((r["case number"], r["medicaid id"]) for r in df.collect()) == [("1", "0000000001"), ("2", "0000000002")]


def test_read_many_by_name_quotes_and_null_tokens(spark, tmp_path):
    _write(tmp_path / "1.csv", PREAMBLE + ["ID,PROVIDER,NOTE", '1, Y ,"say ""hi"", ok"', "2,NA,"])
    _write(tmp_path / "2.csv", PREAMBLE + ["NOTE,ID,PROVIDER", "x,3,P9"])
    got = sorted(map(tuple, files.read_many(spark, [str(tmp_path)], skip=7, keep_source=False).collect()))
    assert got == [("1", "Y", 'say "hi", ok'), ("2", None, None), ("3", "P9", "x")]


def test_read_many_rejects_other_columns(spark, tmp_path):
    import pytest
    _write(tmp_path / "1.csv", ["a,b", "1,2"])
    _write(tmp_path / "2.csv", ["a,c", "1,2"])
    with pytest.raises(ValueError, match="column names differ"):
        files.read_many(spark, [str(tmp_path)])


def test_read_many_splits_large_files(spark, tmp_path):
    """Several tasks read one file; only its first block holds a preamble."""
    _write(tmp_path / "1.csv", PREAMBLE + ["k,v"] + [f"{i},row {i}" for i in range(4000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = files.read_many(spark, [str(tmp_path / "1.csv")], skip=7)
        assert spark.read.text(str(tmp_path / "1.csv")).rdd.getNumPartitions() > 4
        assert sorted(int(r.k) for r in df.collect()) == list(range(4000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_written_quotes_are_doubled(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", ok',)], "k string")
    path = sinks.write_csv(df, str(tmp_path / "q"), "1999-06-30")
    text = "".join(f.read_text() for f in __import__("pathlib").Path(path).glob("*.csv"))
    assert '"say ""hi"", ok"' in text


def test_read_table_infers_types(spark, tmp_path):
    _write(tmp_path / "t.csv", ["a,b", "1, x ", "NA,NA"])
    df = files.read_table(spark, str(tmp_path / "t.csv"))
    assert df.dtypes == [("a", "int"), ("b", "string")] and sorted(map(tuple, df.collect()), key=repr) == [(1, "x"), (None, None)]


def test_read_table(spark, tmp_path):
    p = tmp_path / "qi.csv"
    _write(p, ["MEDICAID RECIP ID,DATE OF BIRTH", "12,1980-01-02"])
    df = files.read_table(spark, str(p), "`MEDICAID RECIP ID` STRING, `DATE OF BIRTH` DATE")
    r = df.first()
    assert r[0] == "12" and str(r[1]) == "1980-01-02"


def test_write_csv_dated(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    path = sinks.write_csv(df, str(tmp_path / "summary"), "1999-06-30")
    assert path.endswith("summary_1999-06-30")
    back = spark.read.option("header", True).csv(path)
    assert back.collect()[0].k == "a"


def test_write_split_orders_within_group(spark, tmp_path):
    rows = [("A", "2017-01-0%d" % i) for i in range(1, 8)] + [("B", "2017-02-01"), (None, "2017-03-01")]
    df = spark.createDataFrame(rows, "PROVIDER_NAME string, most_recent_service string") \
        .withColumn("most_recent_service", F.to_date("most_recent_service"))
    base = str(tmp_path / "per_provider")
    sinks.write_split(df, "PROVIDER_NAME", base, "most_recent_service")
    dirs = sorted(os.listdir(base))
    assert "PROVIDER_NAME_dir=A" in dirs and "PROVIDER_NAME_dir=B" in dirs
    a_dir = os.path.join(base, "PROVIDER_NAME_dir=A")
    dates = []
    for f in sorted(x for x in os.listdir(a_dir) if x.endswith(".csv")):
        with open(os.path.join(a_dir, f)) as fh:
            dates += [line.strip().split(",")[1] for line in fh.readlines()[1:]]
    assert dates == sorted(dates, reverse=True) and len(dates) == 7
    with open(os.path.join(a_dir, sorted(x for x in os.listdir(a_dir) if x.endswith(".csv"))[0])) as fh:
        assert fh.readline().strip() == "PROVIDER_NAME,most_recent_service"


def test_row_numbers_are_consecutive(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(7)
    out = sinks.with_row_number(df, [F.col("v").desc()], "row").collect()
    got = sorted((r.row, r.v) for r in out)
    assert [r for r, _ in got] == list(range(1, 1001))
    assert [v for _, v in got] == list(range(999, -1, -1))


def test_run_write_outputs(spark, tmp_path):
    from rosterkit.plans.flows import Run
    run = Run(spark, "/root/testdata/sf0.001")
    out = run.write_outputs(str(tmp_path / "output"))
    assert out["summary"].endswith("percent_complete_summary_1999-06-30")
    summary = spark.read.option("header", True).csv(out["summary"])
    assert summary.count() == run.summary.count()
    assert summary.columns[0] == "CMHSP" and summary.collect()[-1]["CMHSP"] == run.cfg.total_label
    for table in ("trailing_months", "narrative", "crosstab", "director", "supervisor"):
        assert spark.read.option("header", True).csv(out[table]).count() > 0
    assert spark.read.option("header", True).csv(out["worklist"]).count() == run.worklist.count()
    per = spark.read.option("header", True).csv(out["per_provider"] + "/*/*.csv")
    assert per.count() == run.worklist.count()
    fy = spark.read.option("header", True).csv(out["fy_worklist"])
    # the row-name column has an empty header (Spark reads it back as _c0)
    assert fy.columns[0] in ("", "_c0") and sorted(int(x[0]) for x in fy.collect()) == list(range(1, fy.count() + 1))
