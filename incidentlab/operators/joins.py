"""Joins of incidents with per-day tables (sun times, daily weather).

A per-day table holds one row per calendar date, so it stays small however
many incidents there are.  Spark, though, judges a derived table by the size of
what it is derived from: the day table of a terabyte of readings would be
shuffled, and the incidents with it.  So a table that Spark takes for larger
than ``spark.sql.autoBroadcastJoinThreshold`` is built first and written to the
shared checkpoint folder, and the join is planned with its measured size: it is
broadcast if it really is under the threshold.  Only a larger one goes through an
ordinary shuffle join, where AQE splits hot dates.  A table that Spark knows to
be small is left as it is: building the plan then runs no job, and a replaced day
file is seen by the next join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import write_table


def broadcast_limit(df: DataFrame) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes; -1 where broadcasts are off."""
    return int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size of ``df``: from its files, or from what it is derived from."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _day_table(table: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """The key and the wanted columns (any casing), named as the incident side
    expects; ``columns`` maps a lower-cased name to the output name."""
    named = {key.lower(): key, **columns}
    found = {}
    for c in table.columns:
        out = named.get(c.lower())
        if out and out not in found:
            found[out] = table[c].alias(out)
    table = table.select(*found.values())
    if 0 <= broadcast_limit(table) < estimated_bytes(table):
        table = write_table(table, "day-table")
    # a derived table may already lie by date, which would keep AQE from splitting
    # a hot date of the other side; this small exchange sets the join free
    return table.hint("rebalance")


def assert_unique_dates(table: DataFrame, key: str = "date") -> None:
    """Fail when a date occurs twice (it would multiply incident rows)."""
    dup = table.groupBy(key).count().filter("count > 1").limit(1).collect()
    if dup:
        raise ValueError(f"day table has repeated {key} {dup[0][0]!r}")


def with_sun_times(df: DataFrame, sun: DataFrame, date_col: str = "Date", how: str = "inner",
                   check_unique: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Attach ``sunrise``/``sunset`` (and ``extra`` columns) of the incident's
    (UTC) date.  Inner by default: incidents without a sun row are dropped.
    """
    sun = _day_table(sun, date_col, {"sunrise": "sunrise", "sunset": "sunset", **{e.lower(): e for e in extra}})
    if check_unique:
        assert_unique_dates(sun, date_col)
    return df.join(sun, date_col, how)


def with_weather(df: DataFrame, weather: DataFrame, date_col: str = "Date", how: str = "inner",
                 check_unique: bool = False) -> DataFrame:
    """Attach ``temperatureC`` (also accepted as ``temp``) and ``weather`` of the
    incident's date (inner by default)."""
    named = {c.lower() for c in weather.columns}
    degrees = "temperaturec" if "temperaturec" in named else "temp"
    weather = _day_table(weather, date_col, {degrees: "temperatureC", "weather": "weather"})
    if check_unique:
        assert_unique_dates(weather, date_col)
    return df.join(weather, date_col, how)
