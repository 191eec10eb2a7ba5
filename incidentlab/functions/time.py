"""Time expressions: hour/month/year, local -> UTC, UTC date text, clock times.

All inputs are ``TIMESTAMP_NTZ`` wall-clock values, so no result depends on
the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DEFAULT_ZONE

# --- fixed values: text layouts ---
DATE_TEXT = "yyyy-MM-dd"
CLOCK_12H = "h:mm:ss a"
# Zero-padded, fixed-width clock text: comparing two such strings orders them
# in time, microseconds included.
CLOCK_SORTABLE = "HH:mm:ss.SSSSSS"
CLOCK_12H_PATTERN = r"^(\d{1,2}):(\d{2}):(\d{2}) ([AaPp][Mm])$"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_to_utc(ts: str | Column, zone: str = DEFAULT_ZONE) -> Column:
    """Read ``ts`` as a wall-clock time in ``zone`` and return the UTC wall clock.

    Short ids follow the JDK table (``PST`` = America/Los_Angeles, with DST).
    """
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), _c(ts).cast("timestamp_ntz"))


def date_text(ts: str | Column) -> Column:
    """Calendar date as ``yyyy-MM-dd`` text (never the week-based ``YYYY``).
    A zone-free timestamp converts to its date without any zone."""
    return _c(ts).cast("date").cast("string")


def seconds_of_day(ts: str | Column) -> Column:
    """Seconds since midnight of the wall clock, microseconds kept (decimal)."""
    t = _c(ts)
    return (F.hour(t) * 3600 + F.minute(t) * 60).cast("decimal(11,6)") + F.extract(F.lit("SECOND"), t)


def clock_seconds(text: str | Column) -> Column:
    """Seconds since midnight of 12-hour clock text (``3:25:00 PM``); null when
    the text is not such a time (hour 1-12, minutes and seconds 0-59)."""
    t = _c(text)
    h = F.regexp_extract(t, CLOCK_12H_PATTERN, 1).try_cast("int")
    m = F.regexp_extract(t, CLOCK_12H_PATTERN, 2).try_cast("int")
    sec = F.regexp_extract(t, CLOCK_12H_PATTERN, 3).try_cast("int")
    pm = F.upper(F.regexp_extract(t, CLOCK_12H_PATTERN, 4)) == "PM"
    ok = h.between(1, 12) & m.between(0, 59) & sec.between(0, 59)
    value = ((h % 12) + F.when(pm, 12).otherwise(0)) * 3600 + m * 60 + sec
    return F.when(ok, value.cast("decimal(11,6)"))


def clock_time(text: str | Column, pattern: str = CLOCK_12H) -> Column:
    """Parse 12-hour clock text (``3:25:00 PM``) into sortable clock text.

    Unparsable text gives null instead of failing the task.  The parse and the
    format happen at the same instant of 1970-01-01, so the session zone cancels.
    """
    return F.date_format(F.try_to_timestamp(_c(text), F.lit(pattern)), CLOCK_SORTABLE)
