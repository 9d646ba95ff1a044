
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from marketlens.functions.columns import (
    avg6, category_label, clean_str, days_between, late_by_day, late_by_time, try_dec, try_int, try_ts,
    weekday0, zip5,
)
from marketlens.functions.geo import great_circle_km


def one_col(spark, values, t="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {t}")


def test_r1_blank_to_null(spark):
    rows = one_col(spark, ["  ", "", " a ", None]).select(clean_str("v").alias("x")).collect()
    assert [r.x for r in rows] == [None, None, "a", None]


def test_r2_zip_keeps_rightmost_five(spark):
    rows = one_col(spark, ["123", "01234", "123456", " 7 ", "", None]).select(zip5("v").alias("z")).collect()
    assert [r.z for r in rows] == ["00123", "01234", "23456", "00007", None, None]


def test_r3_numbers_never_raise(spark):
    df = one_col(spark, [" 12 ", "12.0", "1e3", "abc", "1,000", "99999999999", "-5"])
    rows = df.select(try_int("v").alias("i"), try_dec("v").alias("d")).collect()
    assert [r.i for r in rows] == [12, None, None, None, None, None, -5]
    assert [r.d for r in rows] == [Decimal("12.00"), Decimal("12.00"), None, None, None,
                                   Decimal("99999999999.00"), Decimal("-5.00")]


def test_r3_timestamps(spark):
    df = one_col(spark, ["2018-01-18", "2018-13-01 00:00:00", "2018", "2018-02-30 10:00:00",
                         " 2018-01-05 07:05:09 ", ""])
    rows = [r.t for r in df.select(try_ts("v").alias("t")).collect()]
    assert rows == [dt.datetime(2018, 1, 18), None, None, None, dt.datetime(2018, 1, 5, 7, 5, 9), None]


def test_r3_timestamps_round_to_whole_seconds(spark):
    texts = ["2018-01-05 03:04:05.499", "2018-01-05 03:04:05.5", "2018-01-05 03:04:05.700", "2018-12-31 23:59:59.999999", "2018-01-05 03:04:05.", "2018-02-30 00:00:00.5"]
    rows = [r.t for r in one_col(spark, texts).select(try_ts("v").alias("t")).collect()]
    at = dt.datetime(2018, 1, 5, 3, 4, 5)
    assert rows == [at, at + dt.timedelta(seconds=1), at + dt.timedelta(seconds=1), dt.datetime(2019, 1, 1), None, None]


def test_r6_late_by_day_vs_time(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2018, 1, 20, 15, 0), dt.datetime(2018, 1, 20, 0, 0)),
         (dt.datetime(2018, 1, 21, 0, 1), dt.datetime(2018, 1, 20, 0, 0)),
         (None, dt.datetime(2018, 1, 20))], "d timestamp_ntz, e timestamp_ntz")
    rows = df.select(late_by_day("d", "e").alias("a"), late_by_time("d", "e").alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(0, True), (1, True), (0, None)]


def test_r8_datediff_counts_midnights(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 1, 1, 23, 59), dt.datetime(2018, 1, 2, 0, 1))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert df.select(days_between("a", "b").alias("d")).first().d == 1


def test_r4_avg6_exact_half_up(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    assert df.agg(avg6("x").alias("a")).first().a == Decimal("1.666667")
    df = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.02"),)], "x decimal(10,2)")
    assert df.agg(avg6("x", 2).alias("a")).first().a == Decimal("0.015000")


def test_r7_category_label(spark):
    df = spark.createDataFrame([("en", "pt"), (None, "pt"), (None, None)], "e string, n string")
    rows = df.select(category_label("e", "n", "x").alias("c")).collect()
    assert [r.c for r in rows] == ["en", "pt", "x"]


def test_r21_round_half_away_from_zero(spark):
    df = spark.createDataFrame([(Decimal("2.675"),), (Decimal("-2.675"),)], "x decimal(10,3)")
    assert [r.r for r in df.select(F.round("x", 2).alias("r")).collect()] == [Decimal("2.68"), Decimal("-2.68")]


def test_r22_identical_points_clamped_to_zero(spark):
    df = spark.createDataFrame([(Decimal("-23.5"), Decimal("-46.6"))], "a decimal(18,15), b decimal(18,15)")
    km = df.select(great_circle_km("a", "b", "a", "b").alias("k")).first().k
    assert km == 0.0


def test_r24_weekday_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(1900, 1, 1),), (dt.datetime(2018, 1, 7),)], "t timestamp_ntz")
    assert [r.w for r in df.select(weekday0("t").alias("w")).collect()] == [0, 6]
