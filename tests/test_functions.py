import datetime as dt

from pyspark.sql import functions as F

from rosterkit import functions as rf

D = dt.date


def one_col(spark, values, ddl="x string"):
    return spark.createDataFrame([(v,) for v in values], ddl)


def test_normalize_id_edges(spark):
    cases = {
        " 12345 ": "0000012345",
        "AB-12345678901": "2345678901",
        "": None,
        "000": None,
        "NA": None,
        None: None,
        "12 34": None,
        "123456 890": "123456 890",
        "A 123": "0000000123",
        "ID-12": "0000000012",
        "12+34": None,  # a symbol is not punctuation: stays, then fails the parse
    }
    df = one_col(spark, list(cases)).select("x", rf.normalize_id("x").alias("y"))
    got = {r.x: r.y for r in df.collect()}
    assert got == cases


def test_pad_then_normalize(spark):
    df = one_col(spark, [" 12", "AB1234567890", "12"]).select("x", rf.pad_then_normalize("x").alias("y"))
    got = {r.x: r.y for r in df.collect()}
    assert got == {" 12": "0000000 12", "AB1234567890": "1234567890", "12": "0000000012"}


def test_mixed_dates(spark):
    cases = {"9/1/2017": D(2017, 9, 1), "09/01/17": D(2017, 9, 1), "2017-9-1": D(2017, 9, 1),
             " 1/2/85 ": D(1985, 1, 2), "20170901": None, "x": None, None: None}
    df = one_col(spark, list(cases)).select("x", rf.parse_mixed_date("x").alias("y"))
    assert {r.x: r.y for r in df.collect()} == cases


def test_excel_dates(spark):
    cases = {"43009": D(2017, 10, 1), "43009.0": D(2017, 10, 1), "43009.5": D(2017, 10, 1), "abc": None}
    df = one_col(spark, list(cases)).select("x", rf.excel_serial_to_date("x").alias("y"))
    assert {r.x: r.y for r in df.collect()} == cases


def test_calendar_add(spark):
    df = spark.createDataFrame([(D(2017, 5, 31),), (D(2016, 2, 29),), (D(2017, 1, 15),), (None,)], "d date")
    r = df.select("d", rf.add_calendar_months("d", 9).alias("m9"), rf.add_years("d", 3).alias("y3"),
                  rf.add_calendar_months("d", 9, invalid="clamp").alias("c9")).collect()
    got = {x.d: (x.m9, x.y3, x.c9) for x in r}
    assert got[D(2017, 5, 31)] == (None, D(2020, 5, 31), D(2018, 2, 28))
    assert got[D(2016, 2, 29)][1] is None
    assert got[D(2017, 1, 15)][0] == D(2017, 10, 15)
    assert got[None] == (None, None, None)


def test_fiscal_year_end(spark):
    df = spark.range(1)
    r = df.select(rf.fiscal_year_end("1999-09-30").alias("a"), rf.fiscal_year_end("1999-10-01").alias("b"),
                  rf.fiscal_year_end("1999-10-01", rollover_month=11).alias("c"),
                  rf.fiscal_year_end("1999-11-01").alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (D(1999, 9, 30), D(2000, 9, 30), D(1999, 9, 30), D(2000, 9, 30))


def test_week_functions(spark):
    df = spark.createDataFrame([(D(2017, 1, 1),), (D(2019, 10, 9),), (D(2019, 10, 6),), (D(2017, 1, 8),)], "d date")
    r = df.select("d", rf.week_of_year("d").alias("w"), rf.floor_week_sunday("d").alias("s"),
                  rf.floor_month("d").alias("m")).collect()
    got = {x.d: (x.w, x.s, x.m) for x in r}
    assert got[D(2017, 1, 1)][0] == 1
    assert got[D(2017, 1, 8)][0] == 2
    assert got[D(2019, 10, 9)][1] == D(2019, 10, 6)
    assert got[D(2019, 10, 6)][1] == D(2019, 10, 6)
    assert got[D(2019, 10, 9)][2] == D(2019, 10, 1)


def test_minutes_and_era(spark):
    df = spark.createDataFrame([(D(2017, 3, 1), "10:00AM", "11:30AM"), (D(2015, 3, 1), "10:00:30AM", "11:00:00AM")],
                               "d date, s string, e string")
    r = df.select(rf.minutes_between(rf.era_timestamp("d", "s"), rf.era_timestamp("d", "e")).alias("m")).collect()
    assert [x.m for x in r] == [90.0, 59.5]


def test_floor_at_and_if_else(spark):
    df = spark.createDataFrame([(None, None), (D(2016, 1, 1), True), (D(2018, 1, 1), False)], "d date, b boolean")
    r = df.select("d", rf.floor_at("d", "2017-09-30").alias("f"), rf.if_else(F.col("b"), F.lit(1), F.lit(0)).alias("i")).collect()
    got = {x.d: (x.f, x.i) for x in r}
    assert got[None] == (None, None)
    assert got[D(2016, 1, 1)] == (D(2017, 9, 30), 1)
    assert got[D(2018, 1, 1)] == (D(2018, 1, 1), 0)


def test_percent(spark):
    df = spark.createDataFrame([(1, 0), (9, 400), (1, 400), (3, 80), (1, 3)], "n long, d long")
    r = [x.p for x in df.select(rf.percent("n", "d").alias("p")).collect()]
    assert r == [None, 2.2, 0.2, 3.8, 33.3]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", D(2017, 1, 1), None), ("a", None, None), ("b", D(2018, 1, 1), True),
                                ("b", D(2019, 1, 1), False), ("c", None, True)], "k string, d date, f boolean")
    r = {x.k: x for x in df.groupBy("k").agg(rf.max_null_propagating("d").alias("m"),
                                             rf.count_true("f").alias("t"), rf.count_null("d").alias("n")).collect()}
    assert r["a"].m is None and r["a"].t == 0 and r["a"].n == 1
    assert r["b"].m == D(2019, 1, 1) and r["b"].t == 1
    v = one_col(spark, ["a", "a", None]).agg(rf.count_distinct_with_null("x").alias("n")).first().n
    assert v == 2


def test_mdy_hms_truncated_and_pivot(spark):
    df = one_col(spark, ["9/1/2017 13:05:09", "9/1/2017 13:05", "9/1/2017 13", "9/1/2017", "x"])
    r = {x.x: x for x in df.select("x", rf.parse_mdy_hms("x", truncated=3).alias("t"),
                                   rf.parse_mdy_hms("x").alias("strict")).collect()}
    assert str(r["9/1/2017 13:05:09"].t) == "2017-09-01 13:05:09"
    assert str(r["9/1/2017 13:05"].t) == "2017-09-01 13:05:00" and r["9/1/2017 13:05"].strict is None
    assert str(r["9/1/2017"].t) == "2017-09-01 00:00:00"
    assert r["x"].t is None
    piv = {x.x: x.d for x in one_col(spark, ["1/1/68", "1/1/69", "12/31/99", "2/30/2017"])
           .select("x", rf.parse_mdy("x").alias("d")).collect()}
    assert piv == {"1/1/68": D(2068, 1, 1), "1/1/69": D(1969, 1, 1), "12/31/99": D(1999, 12, 31), "2/30/2017": None}


def test_normalize_id_integer_forms(spark):
    cases = {"+123": "0000000123", "12\t": "0000000012", "$12": None, "0012": "0000000012",
             "1234567890123": "4567890123", "ÄB12": "0000000012", "12·34": "0000001234", "12¢34": None}
    df = one_col(spark, list(cases)).select("x", rf.normalize_id("x").alias("y"))
    assert {r.x: r.y for r in df.collect()} == cases
