"""Truth tables of the scalar features (expected values fixed in FIXTURES.md §4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from incidentlab.functions import (address_type, clock_seconds, clock_time, contains_point,
                                   date_text, day_or_night, local_to_utc, seconds_of_day,
                                   street_name, weekend_flag, wkt_edges)
from incidentlab.functions.geometry import edges_valid


def rows(spark, data, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*cols).collect()]


STREETS = [
    ("800 Block of BRYANT ST", "BRYANT ST", "street"),
    ("10000 Block of X ST", "X ST", "street"),
    ("OAK ST / LAGUNA ST", "LAGUNA ST", "Intersection"),
    ("A / B / C", "A / B", "Intersection"),
    ("A/B", "A/B", "Intersection"),
    ("PIER 39", "PIER 39", "street"),
    ("0 Block of", "0 Block of", "street"),
    (None, None, None),
]


def test_street_and_address_type(spark):
    got = rows(spark, [(a,) for a, _, _ in STREETS], "a string",
               street_name("a"), address_type("a"))
    assert got == [(s, t) for _, s, t in STREETS]


def test_weekend(spark):
    days = ["Friday", "Saturday", "Sunday", "Monday", "friday", None]
    got = rows(spark, [(d,) for d in days], "d string", weekend_flag("d"))
    assert [g[0] for g in got] == [1, 1, 1, 0, 0, 0]


DAY_NIGHT = [
    ("10:00:00", "14:00:00", "01:00:00", "Night"),
    ("01:00:00", "14:00:00", "01:00:00", "Day"),
    ("23:00:00", "14:00:00", "01:00:00", "Day"),
    ("12:00:00", "06:00:00", "18:00:00", "Day"),
    ("06:00:00", "06:00:00", "18:00:00", "Night"),
    ("05:00:00", "06:00:00", "06:00:00", "Night"),
]


def test_day_night_truth_table(spark):
    got = rows(spark, [r[:3] for r in DAY_NIGHT], "t string, r string, s string",
               day_or_night("t", "r", "s"))
    assert [g[0] for g in got] == [r[3] for r in DAY_NIGHT]


def test_day_night_on_numbers_and_null(spark):
    got = rows(spark, [(10.0, 14.0, 1.0), (None, 1.0, 2.0)], "t double, r double, s double",
               day_or_night("t", "r", "s"))
    assert got == [("Night",), (None,)]


def test_local_to_utc_pst_with_dst(spark):
    data = [(dt.datetime(2015, 5, 13, 23, 53),), (dt.datetime(2015, 1, 13, 16, 0),),
            (dt.datetime(2015, 3, 8, 2, 30),), (dt.datetime(2015, 11, 1, 1, 30),)]
    got = rows(spark, data, "t timestamp_ntz", local_to_utc("t"), date_text(local_to_utc("t")))
    assert got == [(dt.datetime(2015, 5, 14, 6, 53), "2015-05-14"),
                   (dt.datetime(2015, 1, 14, 0, 0), "2015-01-14"),
                   (dt.datetime(2015, 3, 8, 10, 30), "2015-03-08"),       # DST gap
                   (dt.datetime(2015, 11, 1, 8, 30), "2015-11-01")]       # overlap: earlier offset


def test_local_to_utc_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = rows(spark, [(dt.datetime(2015, 3, 8, 2, 30),)], "t timestamp_ntz",
                   date_text(local_to_utc("t")), seconds_of_day(local_to_utc("t")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got[0][0] == "2015-03-08" and float(got[0][1]) == 10.5 * 3600


def test_clock_parse(spark):
    texts = ["1:23:45 AM", "3:05:09 PM", "12:00:00 AM", "12:30:00 PM", "3:05:09 pm",
             "13:00:00 PM", "garbage", None]
    got = rows(spark, [(t,) for t in texts], "t string", clock_seconds("t"), clock_time("t"))
    secs = [None if g[0] is None else float(g[0]) for g in got]
    assert secs == [5025.0, 54309.0, 0.0, 45000.0, 54309.0, None, None, None]
    assert [g[1] for g in got][:3] == ["01:23:45.000000", "15:05:09.000000", "00:00:00.000000"]


def test_seconds_of_day_keeps_fraction(spark):
    got = rows(spark, [(dt.datetime(2024, 1, 1, 6, 0, 0, 500000),)], "t timestamp_ntz",
               seconds_of_day("t"))
    assert float(got[0][0]) == 6 * 3600 + 0.5


SQUARES = [
    ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))",),
    ("POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))",),
    ("POLYGON ((10 0, 20 0, 20 10, 10 10, 10 0), (14 4, 16 4, 16 6, 14 6, 14 4))",),
]


@pytest.mark.parametrize("x,y,expected", [
    (1, 1, [True, False, False]),
    (3, 3, [True, True, False]),
    (15, 5, [False, False, False]),      # in the hole
    (12, 5, [False, False, True]),
    (50, 50, [False, False, False]),
    (4, 2, [False, False, False]),       # on an edge of the first, corner of the second
    (0, 0, [False, False, False]),       # vertex
])
def test_contains_point(spark, x, y, expected):
    df = spark.createDataFrame(SQUARES, "w string").withColumn("e", wkt_edges("w")) \
        .withColumns({"x": F.lit(float(x)), "y": F.lit(float(y))})
    got = [r[0] for r in df.select(contains_point("e", "x", "y")).collect()]
    assert got == expected


def test_wkt_multipolygon_and_open_ring(spark):
    df = spark.createDataFrame([
        ("MULTIPOLYGON (((0 0, 2 0, 1 2, 0 0)), ((5 5, 6 5, 6 6, 5 6, 5 5)))",),
        ("POLYGON ((0 0, 2 0, 2 2, 0 2))",),            # open ring gets closed
        ("POLYGON ((0 0, a 0, 2 2, 0 0))",),            # bad number
        ("POINT (1 1)",),
    ], "w string").withColumn("e", wkt_edges("w"))
    got = [(len(r.e), r.v) for r in df.select("e", edges_valid("e").alias("v")).collect()]
    assert got == [(7, True), (4, True), (3, False), (1, False)]
