"""Parse landed responses of the two daily services.

The source application fetched one response per date on the driver and
parsed it there.  Here the responses are rows ``(date, body)`` (landed by any
fetcher) and parsing is a distributed projection; a response that cannot be
used goes to a ``rejected`` DataFrame instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: response layouts ---
SUN_RESULTS_SCHEMA = "results map<string,string>"
WEATHER_HEADER_LINES = 2
WEATHER_TEMP_FIELD = 1
WEATHER_CONDITION_FIELD = 11
LINES_PER_RESPONSE = 10 ** 9       # line numbers stay below this in a sequence key


def parse_sun_responses(df: DataFrame, body: str = "body",
                        date: str = "date") -> tuple[DataFrame, DataFrame]:
    """``(date, sunrise, sunset)`` from JSON bodies with a ``results`` object.

    A missing key gives null; a body that is not JSON or has no ``results``
    object is rejected as ``(date, body, reason)``.
    """
    parsed = df.withColumn("__r", F.from_json(F.col(body), SUN_RESULTS_SCHEMA)["results"])
    ok = F.col("__r").isNotNull()
    good = parsed.filter(ok).select(
        F.col(date).alias("date"),
        F.try_element_at("__r", F.lit("sunrise")).alias("sunrise"),
        F.try_element_at("__r", F.lit("sunset")).alias("sunset"))
    bad = parsed.filter(~ok).select(F.col(date).alias("date"), F.col(body).alias("body"),
                                    F.lit("no results object").alias("reason"))
    return good, bad


def _fields(line: Column) -> Column:
    # JVM-style split: trailing empty fields are dropped before counting
    return F.split(F.regexp_replace(line, ",+$", ""), ",")


def parse_weather_responses(df: DataFrame, body: str = "body", date: str = "date",
                            order: str | None = None,
                            skip: int = WEATHER_HEADER_LINES) -> tuple[DataFrame, DataFrame]:
    """Readings ``(date, temp, weather, seq)`` from comma-separated text bodies.

    The first ``skip`` lines of a body are headers.  Field 1 is the
    temperature, field 11 the condition (0-based).  ``seq`` orders readings
    within a date: ``order * 10^9 + line`` (an integral ``order`` column,
    e.g. a response id) when given, else the line number; one integral key
    keeps the roll-up's partial aggregation hash-based.  The readings keep
    ``line_no`` (and ``order``).  Lines with fewer than 12 fields or a
    temperature that is not a number are rejected as
    ``(date, [order,] line_no, line, reason)``.
    """
    keep = [F.col(date).alias("date")] + ([F.col(order).alias("__order")] if order else [])
    parts = F.split(F.col(body), r"\r?\n")
    lines = (df.select(*keep, F.size(parts).alias("__n"), F.posexplode(parts).alias("line_no", "line"))
             # a body that ends in a newline has no empty last line
             .filter((F.col("line_no") >= skip)
                     & ~((F.col("line_no") == F.col("__n") - 1) & (F.col("line") == ""))))
    fields = _fields(F.col("line"))
    temp = F.get(fields, WEATHER_TEMP_FIELD).try_cast("double")
    enough = F.size(fields) > WEATHER_CONDITION_FIELD
    checked = lines.withColumns({
        "temp": F.when(enough, temp),
        "weather": F.when(enough, F.get(fields, WEATHER_CONDITION_FIELD)),
        "reason": F.when(~enough, F.lit("too few fields"))
                   .when(temp.isNull(), F.lit("temperature is not a number")),
    })
    seq = (F.col("__order").cast("decimal(38,0)") * LINES_PER_RESPONSE + F.col("line_no")
           if order else F.col("line_no"))
    good = checked.filter(F.col("reason").isNull()).select(
        "date", "temp", "weather", seq.alias("seq"),
        *(["__order"] if order else []), "line_no")
    if order:
        good = good.withColumnRenamed("__order", order)
    bad = checked.filter(F.col("reason").isNotNull()).select(
        "date", *(["__order"] if order else []), "line_no", "line", "reason")
    if order:
        bad = bad.withColumnRenamed("__order", order)
    return good, bad
