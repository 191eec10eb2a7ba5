"""Schemas and fixed names shared by every operator.

Timestamps are ``TIMESTAMP_NTZ`` throughout: an incident time is a local
wall-clock reading, and keeping it zone-free makes every derived value
independent of ``spark.sql.session.timeZone`` on whatever cluster runs the job.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: incident file layout (column order of the CSV files) ---
INCIDENT_FIELDS = [
    T.StructField("Id", T.LongType()),
    T.StructField("Dates", T.TimestampNTZType()),
    T.StructField("Category", T.StringType()),
    T.StructField("Descript", T.StringType()),
    T.StructField("DayOfWeek", T.StringType()),
    T.StructField("PdDistrict", T.StringType()),
    T.StructField("Resolution", T.StringType()),
    T.StructField("Address", T.StringType()),
    T.StructField("X", T.DoubleType()),
    T.StructField("Y", T.DoubleType()),
]

# --- fixed values: feature and output column names ---
LABEL_COL = "Category"
PREDICTED_COL = "PredictedCategory"
FEATURES_COL = "Features"
INDEXED_SUFFIX = "Indexed"
NUMERIC_FEATURES = ["X", "Y", "temperatureC"]
CATEGORY_FEATURES = [
    "DayOfWeek", "PdDistrict", "DayOrNight", "Weekend", "HourOfDay", "Month",
    "Year", "AddressType", "Street", "weather", "Neighborhood",
]
PREDICTION_COLUMNS = [
    "Dates", "DayOfWeek", "PdDistrict", "Address", "X", "Y", "HourOfDay",
    "Month", "Year", "Weekend", "Street", "sunrise", "sunset", "DayOrNight",
    "weather", "Neighborhood", PREDICTED_COL,
]

# --- fixed values: defaults of the source application ---
DEFAULT_ZONE = "PST"
DEFAULT_NEIGHBORHOOD = "SF"
DEFAULT_MAX_BINS = 2089

SUN_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("sunrise", T.StringType()),
    T.StructField("sunset", T.StringType()),
])

POLYGON_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("polygon", T.StringType()),
])


_PREDICTION_TYPES = {
    "Dates": T.TimestampNTZType(), "X": T.DoubleType(), "Y": T.DoubleType(),
    "HourOfDay": T.IntegerType(), "Month": T.IntegerType(), "Year": T.IntegerType(),
    "Weekend": T.IntegerType(),
}


def prediction_schema(with_id: bool = False) -> T.StructType:
    """Types of the prediction CSV columns (text unless listed above)."""
    fields = [T.StructField("Id", T.LongType())] if with_id else []
    return T.StructType(fields + [T.StructField(c, _PREDICTION_TYPES.get(c, T.StringType()))
                                  for c in PREDICTION_COLUMNS])


def incident_schema(exclude: tuple[str, ...] = ("Id",)) -> T.StructType:
    """Incident CSV schema without the ``exclude`` columns (training files
    carry no ``Id``)."""
    return T.StructType([f for f in INCIDENT_FIELDS if f.name not in exclude])
