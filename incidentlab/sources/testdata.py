"""Inputs derived by Spark from the driver's tables (``/root/testdata/sf*``).

* ``incidents``: one incident per event (``events`` joined to ``nation``).
* ``sun_times``: one row per local event date, with 12-hour clock texts that
  follow a rule of the day number (wrapped UTC days, plain days, noon).
* ``weather_readings``: one reading per event (temperature = ``value``,
  condition = ``event_type``), keyed by the event's local date.

The incidents' UTC dates run one day past the local dates, so the last UTC
date has no sun or weather row and the inner joins drop it, as they would for
a missing day in real data.  All three grow with ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

# --- fixed values: the three test polygons, in lookup order ---
TEST_POLYGONS = [
    (0, "West", "POLYGON ((-122.52 37.70, -122.45 37.70, -122.45 37.80, -122.52 37.80, -122.52 37.70))"),
    (1, "Overlap", "POLYGON ((-122.47 37.72, -122.40 37.72, -122.40 37.78, -122.47 37.78, -122.47 37.72), "
                   "(-122.44 37.74, -122.43 37.74, -122.43 37.75, -122.44 37.75, -122.44 37.74))"),
    (2, "Multi", "MULTIPOLYGON (((-122.40 37.80, -122.36 37.80, -122.38 37.84, -122.40 37.80)), "
                 "((-122.39 37.70, -122.36 37.70, -122.36 37.71, -122.39 37.71, -122.39 37.70)))"),
]

# --- fixed values: sun-time rules by day of month d ---
#   d % 10 == 0 : sunrise 12:<d>:00 PM, sunset 11:59:59 PM   (noon edge)
#   d odd       : sunrise 3:<10+d>:00 PM, sunset 1:<d>:<d> AM (UTC clock wraps)
#   otherwise   : sunrise 6:<d>:00 AM, sunset 6:<30-d>:00 PM


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident rows in the layout of the incident CSV files (``Id`` kept)."""
    ev = spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"),
                by_rows=True)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = ev.join(nation, (F.col("user_id") % 25) == F.col("n_nationkey"))
    eid, uid, name = F.col("event_id"), F.col("user_id"), F.col("n_name")
    k = eid % 4
    address = (F.when(k == 0, F.concat(((uid % 50) * 100).cast("string"), F.lit(" Block of "), name, F.lit(" ST")))
               .when(k == 1, F.concat(name, F.lit(" ST / NATION_"), (eid % 25).cast("string"), F.lit(" ST")))
               .when(k == 2, F.concat(F.lit("PIER "), (uid % 60).cast("string")))
               .otherwise(F.concat(name, F.lit("/X"))))
    ts = F.col("ts")
    return j.select(
        eid.alias("Id"),
        ts.cast("timestamp_ntz").alias("Dates"),
        F.col("event_type").alias("Category"),
        F.date_format(ts.cast("date"), "EEEE").alias("DayOfWeek"),
        name.alias("PdDistrict"),
        address.alias("Address"),
        # exact decimal arithmetic, then one rounding to double
        (F.expr("-122.52") + (eid % 997) * F.expr("0.00017")).cast("double").alias("X"),
        (F.expr("37.70") + (eid % 983) * F.expr("0.00015")).cast("double").alias("Y"))


def local_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every local date from the first to the last event (one row each)."""
    from .spine import date_spine_of
    ev = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("d"))
    return date_spine_of(ev, "d")


def sun_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(date, sunrise, sunset)`` texts for every local event date."""
    d = F.dayofmonth("date")
    noon, odd = (d % 10) == 0, (d % 2) == 1
    sunrise = (F.when(noon, F.format_string("12:%02d:00 PM", d))
               .when(odd, F.format_string("3:%02d:00 PM", d + 10))
               .otherwise(F.format_string("6:%02d:00 AM", d)))
    sunset = (F.when(noon, F.lit("11:59:59 PM"))
              .when(odd, F.format_string("1:%02d:%02d AM", d, d))
              .otherwise(F.format_string("6:%02d:00 PM", 30 - d)))
    return local_dates(spark, sf_dir).select(
        F.col("date").cast("string").alias("date"), sunrise.alias("sunrise"), sunset.alias("sunset"))


def weather_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(date, temp, weather, seq)``: one reading per event."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("ts").cast("date").cast("string").alias("date"),
                     F.col("value").alias("temp"), F.col("event_type").alias("weather"),
                     F.col("event_id").alias("seq"))


def polygons(spark: SparkSession) -> DataFrame:
    """The three test polygons as ``(ord, name, polygon)``."""
    return spark.createDataFrame(TEST_POLYGONS, "ord long, name string, polygon string")


# --- fixed values: landed response layouts used by the fixtures ---
WEATHER_HEADER = ("TimePST,TemperatureC,DewPointC,Humidity,SeaLevelPressurehPa,VisibilityKm,"
                  "WindDirection,WindSpeedKmh,GustSpeedKmh,Precipitationmm,Events,Conditions,"
                  "WindDirDegrees")
SUN_UNAVAILABLE_DAY = 15           # that day's body is not JSON
SUN_PARTIAL_EVERY = 10             # days d % 10 == 0 have no sunset key
WEATHER_NO_TEMP_BELOW = 1.0        # readings below it carry "-" as temperature
WEATHER_SHORT_ABOVE = 480.0        # readings above it are cut to five fields


def sun_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(date, body)``: one landed JSON response per local event date."""
    sun = sun_times(spark, sf_dir)
    d = F.dayofmonth(F.to_date("date"))
    full = F.to_json(F.struct(F.struct("sunrise", "sunset").alias("results"),
                              F.lit("OK").alias("status")))
    partial = F.to_json(F.struct(F.struct("sunrise").alias("results"), F.lit("OK").alias("status")))
    body = (F.when(d == SUN_UNAVAILABLE_DAY, F.lit("Service unavailable"))
            .when(d % SUN_PARTIAL_EVERY == 0, partial).otherwise(full))
    return sun.select("date", body.alias("body"))


def weather_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(date, rid, body)``: one landed text response per event, two header
    lines then one comma-separated reading."""
    ev = spread(table(spark, sf_dir, "events"), by_rows=True)
    v = F.col("value")
    temp = F.when(v < WEATHER_NO_TEMP_BELOW, F.lit("-")).otherwise(F.format_string("%.2f", v))
    fields = [F.date_format("ts", "HH:mm"), temp, F.lit("7.0"), F.lit("80"), F.lit("1015.0"),
              F.lit("10.0"), F.lit("West"), F.lit("5.8"), F.lit("-"), F.lit("N/A"), F.lit(""),
              F.col("event_type"), F.lit("270")]
    line = F.when(v > WEATHER_SHORT_ABOVE, F.concat_ws(",", *fields[:5])) \
        .otherwise(F.concat_ws(",", *fields))
    body = F.concat(F.lit(WEATHER_HEADER + "\n<br />\n"), line, F.lit("\n"))
    return ev.select(F.col("ts").cast("date").cast("string").alias("date"),
                     F.col("event_id").alias("rid"), body.alias("body"))
