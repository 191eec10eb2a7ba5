"""Categorical labels derived from text columns: weekend flag, address type,
street name and day/night.  Each is a single native expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: weekend day names, address patterns and literals ---
WEEKEND_DAYS = ["Friday", "Saturday", "Sunday"]
STREET_PATTERN = r"\d{1,4} Block of (.+)"
INTERSECTION_PATTERN = r"(.+) / (.+)"
INTERSECTION = "Intersection"
STREET = "street"
DAY = "Day"
NIGHT = "Night"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weekend_flag(day: str | Column) -> Column:
    """1 for Friday, Saturday, Sunday (exact, case-sensitive), else 0; null -> 0."""
    return F.when(_c(day).isin(WEEKEND_DAYS), F.lit(1)).otherwise(F.lit(0))


def address_type(address: str | Column) -> Column:
    """``Intersection`` when the address has a ``/``, else ``street``; null stays null."""
    a = _c(address)
    return (F.when(a.isNull(), F.lit(None).cast("string"))
            .when(a.contains("/"), F.lit(INTERSECTION))
            .otherwise(F.lit(STREET)))


def street_name(address: str | Column) -> Column:
    """Street of an address.

    ``N Block of S`` (searched anywhere, so ``10000 Block of X`` gives ``X``)
    -> ``S``; otherwise ``A / B`` (greedy, so ``A / B / C`` splits into
    ``A / B`` and ``C``) -> the smaller of the two; otherwise the address.
    """
    a = _c(address)
    block = F.regexp_extract(a, STREET_PATTERN, 1)
    left = F.regexp_extract(a, INTERSECTION_PATTERN, 1)
    right = F.regexp_extract(a, INTERSECTION_PATTERN, 2)
    # both patterns capture at least one character, so '' means "no match"
    return (F.when(a.isNull(), F.lit(None).cast("string"))
            .when(block != "", block)
            .when(left != "", F.least(left, right))
            .otherwise(a))


def day_or_night(t: str | Column, sunrise: str | Column, sunset: str | Column) -> Column:
    """Day/Night from three comparable times of day (seconds of day, or
    sortable clock texts).

    When sunrise is after sunset (the UTC clock wrapped past midnight) it is
    night strictly between sunset and sunrise; otherwise it is day strictly
    between sunrise and sunset.  Equal times fall to the other side.  Any null
    input gives null.
    """
    t, rise, set_ = _c(t), _c(sunrise), _c(sunset)
    wrapped = rise > set_
    return (F.when(t.isNull() | rise.isNull() | set_.isNull(), F.lit(None).cast("string"))
            .when(wrapped, F.when((t > set_) & (t < rise), F.lit(NIGHT)).otherwise(F.lit(DAY)))
            .otherwise(F.when((t > rise) & (t < set_), F.lit(DAY)).otherwise(F.lit(NIGHT))))
