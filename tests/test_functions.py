import datetime as dt

from pyspark.sql import functions as F

from hirelake.functions.scalar import (blank_to_null, csv_int, csv_timestamp, iso_string,
                                       iso_timestamp, signed_label, year_range)


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col(F.col("x")).alias("y")).first()["y"]


def test_csv_timestamp_branches(spark):
    assert one(spark, csv_timestamp, "2021-07-27T16:02:08Z") is None          # Z, no fraction
    assert one(spark, csv_timestamp, "2021-07-27T16:02:08.000Z") == dt.datetime(2021, 7, 27, 16, 2, 8)
    assert one(spark, csv_timestamp, "2021-7-2 1:2:3") == dt.datetime(2021, 7, 2, 1, 2, 3)
    assert one(spark, csv_timestamp, "2021-02-30 10:00:00") is None
    assert one(spark, csv_timestamp, "2021-07-27") is None


def test_iso_timestamp_rejects_zones(spark):
    assert one(spark, iso_timestamp, "2020-01-01T00:00:00") == dt.datetime(2020, 1, 1)
    assert one(spark, iso_timestamp, "2020-01-01") == dt.datetime(2020, 1, 1)
    assert one(spark, iso_timestamp, "2020-01-01T00:00:00Z") is None
    assert one(spark, iso_timestamp, "2020-01-01T00:00:00+02:00") is None
    assert one(spark, iso_timestamp, "nope") is None


def test_iso_string_fraction_only_when_nonzero(spark):
    f = lambda v: one(spark, iso_string, v, "timestamp_ntz")
    assert f(dt.datetime(2021, 1, 2, 3, 4, 5)) == "2021-01-02T03:04:05"
    assert f(dt.datetime(2021, 1, 2, 3, 4, 5, 120)) == "2021-01-02T03:04:05.000120"
    assert f(None) is None


def test_csv_int_and_blank(spark):
    assert one(spark, csv_int, " 5 ") == 5
    assert one(spark, csv_int, "+5") == 5
    assert one(spark, csv_int, "5.0") is None
    assert one(spark, csv_int, "abc") is None
    assert one(spark, csv_int, "2147483648") is None
    assert one(spark, blank_to_null, " \t ") is None
    assert one(spark, blank_to_null, "  ana ") == "ana"


def test_signed_label(spark):
    assert one(spark, signed_label, 0, "int") == "+0"
    assert one(spark, signed_label, -3, "int") == "-3"
    assert one(spark, signed_label, 7, "int") == "+7"


def test_year_range_bounds(spark):
    rows = [(dt.datetime(2020, 12, 31, 23, 59, 59),), (dt.datetime(2021, 1, 1, 0, 0, 0),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    got = [r.ts for r in df.where(year_range("ts", 2020)).collect()]
    assert got == [dt.datetime(2020, 12, 31, 23, 59, 59)]


def test_timestamps_ignore_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        gap = dt.datetime(2021, 3, 14, 2, 30, 0)        # does not exist in New York
        assert one(spark, csv_timestamp, "2021-03-14 2:30:00") == gap
        assert one(spark, iso_string, gap, "timestamp_ntz") == "2021-03-14T02:30:00"
        assert one(spark, csv_timestamp, "2021-01-01 00:00:60") is None
        assert one(spark, csv_timestamp, "21-01-01 00:00:00") is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
