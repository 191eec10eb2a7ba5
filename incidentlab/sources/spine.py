"""Date spines and request lists.

The source application walked a date range on the driver, one request every
few seconds.  Here the range is a DataFrame: a one-row aggregate of the
bounds, exploded into one row per day.  The request URLs are a column.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import iso_date, request_url

# --- fixed values: request templates of the two daily sources ---
SUN_URL_TEMPLATE = "http://api.sunrise-sunset.org/json?lat=%f&lng=%f&date=%s"
WEATHER_URL_TEMPLATE = ("https://www.wunderground.com/history/airport/KSFO/%d/%d/%d/"
                        "DailyHistory.html?format=1")
SF_LAT, SF_LNG = 37.7749, -122.4194


def date_spine(spark: SparkSession, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """One row per date in ``[start, end]`` as column ``date`` (DateType)."""
    return spark.range(1).select(F.explode(F.sequence(
        F.to_date(F.lit(str(start))), F.to_date(F.lit(str(end))))).alias("date"))


def date_spine_of(df: DataFrame, col: str) -> DataFrame:
    """Every date between the smallest and largest value of ``col``."""
    bounds = df.agg(F.min(F.col(col).cast("date")).alias("lo"), F.max(F.col(col).cast("date")).alias("hi"))
    return bounds.select(F.explode(F.sequence("lo", "hi")).alias("date"))


def with_request_url(df: DataFrame, template: str, *args: str | Column,
                     out: str = "url") -> DataFrame:
    """Add the request URL for each row from a ``printf`` template."""
    return df.withColumn(out, request_url(template, *args))


def sun_requests(dates: DataFrame, lat: float = SF_LAT, lng: float = SF_LNG) -> DataFrame:
    """``(date, url)`` for the sunrise/sunset service."""
    d = dates.select(iso_date("date").alias("date"))
    return with_request_url(d, SUN_URL_TEMPLATE, F.lit(lat), F.lit(lng), F.col("date"))


def weather_requests(dates: DataFrame) -> DataFrame:
    """``(date, url)`` for the daily weather history service."""
    d = dates.select(F.col("date").cast("date").alias("d"))
    return with_request_url(d, WEATHER_URL_TEMPLATE, F.year("d"), F.month("d"), F.dayofmonth("d")) \
        .select(iso_date("d").alias("date"), "url")
