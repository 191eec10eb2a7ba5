"""Text formatting: ISO dates and request URLs built from templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_date(d: str | Column) -> Column:
    """``yyyy-MM-dd`` text of a date."""
    return _c(d).cast("date").cast("string")


def request_url(template: str, *args: str | Column) -> Column:
    """``printf``-style template filled per row (``%f`` prints six decimals,
    ``%d`` an integer, ``%s`` text)."""
    return F.format_string(template, *[_c(a) for a in args])
