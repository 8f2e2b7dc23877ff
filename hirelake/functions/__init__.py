"""Column-level helpers: every function returns a native Column."""

from hirelake.functions.scalar import (  # noqa: F401
    blank_to_null, csv_int, csv_timestamp, iso_string, iso_timestamp, is_blank,
    signed_label, strip_ws, year_range,
)
