"""Native Column builders (no Python UDFs): everything here compiles into
Catalyst expressions and runs inside the JVM."""

from .geometry import (bounding_box, contains_point, crossing_parity, edges_valid,
                       in_box, on_boundary, wkt_edges)
from .labels import address_type, day_or_night, street_name, weekend_flag
from .time import clock_seconds, clock_time, date_text, local_to_utc, seconds_of_day
from .text import iso_date, request_url

__all__ = [
    "address_type", "bounding_box", "clock_seconds", "clock_time", "contains_point",
    "crossing_parity", "date_text", "day_or_night", "edges_valid", "in_box",
    "iso_date", "local_to_utc", "on_boundary", "request_url", "street_name",
    "seconds_of_day", "weekend_flag", "wkt_edges",
]
