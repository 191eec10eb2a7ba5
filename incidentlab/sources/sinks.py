"""Sinks: prediction CSV files and per-day JSON tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..schemas import PREDICTION_COLUMNS
from .files import WRITE_TS_FORMAT


def write_predictions(df: DataFrame, path: str, files: int | None = None,
                      mode: str = "errorifexists", columns: list[str] | None = None) -> None:
    """CSV with header of the prediction columns.

    By default every task writes its own part.  ``files`` asks for that many
    part files, by a repartition, so that the scoring stage upstream keeps its
    full parallelism (a coalesce would run it in ``files`` tasks).  The default
    mode refuses an existing path.
    """
    out = df.select(*(columns or PREDICTION_COLUMNS))
    if files:
        out = out.repartition(files)
    (out.write.mode(mode).option("header", True)
     .option("timestampNTZFormat", WRITE_TS_FORMAT).csv(path))


def write_daily_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per date, as JSON lines written by every task."""
    df.write.mode(mode).json(path)
