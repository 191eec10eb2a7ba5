"""Entries B and C: build the per-day sun and weather tables from landed
service responses, and the request lists that drive fetching them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.weather import daily_weather
from ..sources.responses import parse_sun_responses, parse_weather_responses
from ..sources.sinks import write_daily_table
from ..sources.spine import SF_LAT, SF_LNG, SUN_URL_TEMPLATE, WEATHER_URL_TEMPLATE
from ..functions import iso_date, request_url


def request_list(dates: DataFrame, lat: float = SF_LAT, lng: float = SF_LNG) -> DataFrame:
    """``(date, sun_url, weather_url)`` for every date of a spine."""
    d = F.col("date").cast("date")
    return dates.select(
        iso_date(d).alias("date"),
        request_url(SUN_URL_TEMPLATE, F.lit(lat), F.lit(lng), iso_date(d)).alias("sun_url"),
        request_url(WEATHER_URL_TEMPLATE, F.year(d), F.month(d), F.dayofmonth(d)).alias("weather_url"))


def sun_table(responses: DataFrame, body: str = "body", date: str = "date"):
    """``(table, rejected)`` from landed sun responses."""
    return parse_sun_responses(responses, body=body, date=date)


def weather_table(responses: DataFrame, body: str = "body", date: str = "date",
                  order: str | None = None, round_to: int | None = None):
    """``(table, rejected)``: readings parsed, then rolled up per date."""
    readings, rejected = parse_weather_responses(responses, body=body, date=date, order=order)
    return daily_weather(readings, round_to=round_to), rejected


def build_tables(sun_responses: DataFrame, weather_responses: DataFrame, sun_path: str,
                 weather_path: str, mode: str = "errorifexists", **weather_opts) -> dict[str, int]:
    """Parse, roll up and write both per-day tables.

    Responses that cannot be used are written beside each table
    (``<path>_rejected``, with the reason); returns how many there are.
    """
    rejected = {}
    for name, path, (table, bad) in (("sun", sun_path, sun_table(sun_responses)),
                                     ("weather", weather_path, weather_table(weather_responses, **weather_opts))):
        write_daily_table(table, path, mode=mode)
        counted = Observation(f"{name} rejected")
        write_daily_table(bad.observe(counted, F.count(F.lit(1)).alias("n")), f"{path}_rejected", mode=mode)
        rejected[name] = counted.get["n"]
    return rejected
