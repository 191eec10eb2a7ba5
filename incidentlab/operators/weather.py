"""Roll intra-day weather readings up to one row per date.

Mean temperature = sum / count; condition = the most frequent one, ties to
the condition seen first.  Two partial aggregations and no join: readings are
pre-aggregated per (date, condition) on the map side, so a date holding a
large share of all readings never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_weather(readings: DataFrame, date: str = "date", temp: str = "temp",
                  condition: str = "weather", seen: str = "seq",
                  out_temp: str = "temperatureC", round_to: int | None = None) -> DataFrame:
    """``(date, temperatureC, weather)`` from readings ``(date, temp, weather, seq)``.

    ``seq`` orders readings (response then line); the smallest is "seen first".
    """
    per_condition = readings.groupBy(date, condition).agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(temp).alias("__sum"),
        F.count(temp).alias("__cnt"),
        F.min(seen).alias("__first"))
    mean = F.sum("__sum") / F.sum("__cnt")
    if round_to is not None:
        mean = F.round(mean, round_to)
    return per_condition.groupBy(date).agg(
        mean.alias(out_temp),
        F.min_by(condition, F.struct((-F.col("__n")).alias("n"), F.col("__first").alias("f")))
        .alias(condition))
