"""File sources: incident CSV, per-day JSON tables, neighbourhood polygons.

All readers take explicit schemas (no inference pass over the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import POLYGON_SCHEMA, SUN_SCHEMA, incident_schema, prediction_schema
from ..session import spread

# --- fixed values: text layout of timestamps in the incident files ---
READ_TS_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
WRITE_TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def read_incidents(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   corrupt_col: str | None = None) -> DataFrame:
    """Incident CSV with a header.  Default schema: the training layout (no ``Id``).

    Malformed fields become null and the row is kept; with ``corrupt_col`` the
    raw text of such rows is kept in that column.
    """
    schema = schema or incident_schema()
    reader = (spark.read.option("header", True).option("mode", "PERMISSIVE")
              .option("timestampNTZFormat", READ_TS_FORMAT))
    if corrupt_col:
        schema = T.StructType(schema.fields + [T.StructField(corrupt_col, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt_col)
    # enrichment is per-row CPU work: a small or compressed file gets all cores
    return spread(reader.schema(schema).csv(path))


def read_incidents_checked(spark: SparkSession, path: str,
                           schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(incidents, rejected): the rows that fit the schema, and the others as
    ``file``, ``line`` (the row's text) and ``reason``.

    A row is rejected for its number of fields (``fields``) or for a value that
    its column's type does not hold (``value``); an empty field is a null, not a fault.
    Both outputs come from one lazy scan each: nothing is collected or cached, so a
    lost executor costs a re-read.  No rows give two empty frames.
    """
    schema = schema or incident_schema()
    corrupt, where = "_corrupt_line", "_corrupt_file"
    rows = (spark.read.option("header", True).option("mode", "PERMISSIVE")
            .option("timestampNTZFormat", READ_TS_FORMAT).option("columnNameOfCorruptRecord", corrupt)
            .schema(T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])).csv(path)
            .withColumn(where, F.col("_metadata.file_path")))
    # a scan judges the columns it is asked for alone: this always true condition asks for all
    whole = F.pmod(F.hash(*[F.col(f"`{f.name}`") for f in schema.fields]), F.lit(2)) < 2
    good = rows.where(whole & F.col(corrupt).isNull()).drop(corrupt, where)
    # read again as text, a row that is still at fault has another number of fields
    as_text = ", ".join([f"c{k} string" for k in range(len(schema))] + ["bad string"])
    cells = F.from_csv(F.col(corrupt), as_text, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    rejected = rows.where(whole & F.col(corrupt).isNotNull()).select(
        F.col(where).alias("file"), F.col(corrupt).alias("line"),
        F.when(cells["bad"].isNotNull(), "fields").otherwise("value").alias("reason"))
    return spread(good), rejected


def _read_json(spark: SparkSession, path: str, schema: T.StructType, layout: str) -> DataFrame:
    if layout not in ("array", "lines"):
        raise ValueError(f"layout must be 'array' or 'lines', not {layout!r}")
    # an array file is one JSON value per file: each file is read whole by one
    # task and its elements become rows.  JSON lines split like text.
    return spark.read.schema(schema).option("multiLine", layout == "array").json(path)


def read_sun_times(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """``(date, sunrise, sunset)`` text rows; sunrise/sunset may be null."""
    return _read_json(spark, path, SUN_SCHEMA, layout)


def read_daily_weather(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """``(date, temperatureC, weather)``.  Files written with the field name
    ``temp`` are accepted too (no unit conversion)."""
    schema = T.StructType([
        T.StructField("date", T.StringType()), T.StructField("temperatureC", T.DoubleType()),
        T.StructField("temp", T.DoubleType()), T.StructField("weather", T.StringType())])
    df = _read_json(spark, path, schema, layout)
    return df.select("date", F.coalesce("temperatureC", "temp").alias("temperatureC"), "weather")


def read_polygons(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """``(ord, name, polygon)``: ``ord`` keeps file order (by file path, then
    position in the file), which decides between overlapping polygons."""
    df = _read_json(spark, path, POLYGON_SCHEMA, layout)
    return df.select(
        F.struct(F.input_file_name().alias("file"),
                 F.monotonically_increasing_id().alias("pos")).alias("ord"),
        "name", "polygon")


def read_predictions(spark: SparkSession, path: str, with_id: bool = False) -> DataFrame:
    """Prediction CSV files (as written by ``sinks.write_predictions``), typed."""
    return (spark.read.option("header", True).option("timestampNTZFormat", READ_TS_FORMAT)
            .schema(prediction_schema(with_id)).csv(path))
