"""Row-preserving feature operators (``DataFrame -> DataFrame``, usable with
``df.transform``).  All columns come from native expressions, so they fold,
prune and run in whole-stage codegen; none of them shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (address_type, clock_seconds, date_text, day_or_night, local_to_utc,
                         seconds_of_day, street_name, weekend_flag)
from ..schemas import DEFAULT_ZONE
from .joins import with_sun_times


def time_features(df: DataFrame, ts: str = "Dates", zone: str = DEFAULT_ZONE) -> DataFrame:
    """``HourOfDay``, ``Month``, ``Year`` of the local time; ``Timestamp`` = the
    UTC wall clock; ``Date`` = UTC calendar date as ``yyyy-MM-dd``."""
    local = F.col(ts).cast("timestamp_ntz")
    return (df.withColumns({
        "HourOfDay": F.hour(local),
        "Month": F.month(local),
        "Year": F.year(local),
        "Timestamp": local_to_utc(local, zone),
    }).withColumn("Date", date_text("Timestamp")))


def weekend_feature(df: DataFrame, day: str = "DayOfWeek", out: str = "Weekend") -> DataFrame:
    """``Weekend`` = 1 on Friday, Saturday and Sunday, else 0."""
    return df.withColumn(out, weekend_flag(day))


def address_features(df: DataFrame, address: str = "Address") -> DataFrame:
    """``AddressType`` (Intersection/street) and ``Street``."""
    return df.withColumns({"AddressType": address_type(address), "Street": street_name(address)})


def day_night_feature(df: DataFrame, sun: DataFrame | None = None, time_col: str = "Timestamp",
                      date_col: str = "Date", how: str = "inner") -> DataFrame:
    """``DayOrNight`` from the UTC time of day and that date's sunrise/sunset.

    With ``sun`` given, it is joined first (inner: dates without sun times drop)
    and its clock texts are parsed once per date on the small side; without
    it, ``sunrise``/``sunset`` must already be columns of ``df``.
    """
    if sun is None:
        return df.withColumn("DayOrNight", day_or_night(
            seconds_of_day(time_col), clock_seconds("sunrise"), clock_seconds("sunset")))
    sun = sun.withColumns({"__rise": clock_seconds("sunrise"), "__set": clock_seconds("sunset")})
    df = with_sun_times(df, sun, date_col=date_col, how=how, extra=("__rise", "__set"))
    return (df.withColumn("DayOrNight", day_or_night(seconds_of_day(time_col), "__rise", "__set"))
            .drop("__rise", "__set"))


def enrich(df: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply feature steps left to right (``f1`` then ``f2`` ...)."""
    for step in steps:
        df = df.transform(step)
    return df
