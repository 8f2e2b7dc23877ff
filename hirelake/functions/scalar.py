"""Scalar and predicate Column builders.

All of them stay inside the JVM so whole-stage codegen covers them; no
Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every Unicode whitespace character.
_EDGE_WS = r"^\s+|\s+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Trim leading/trailing whitespace (Unicode-aware, like str.strip)."""
    return F.regexp_replace(_c(c), _EDGE_WS, "")


def is_blank(c) -> Column:
    """NULL, empty or whitespace-only."""
    return _c(c).isNull() | (strip_ws(c) == "")


def blank_to_null(c) -> Column:
    """Stripped text, or NULL when nothing is left."""
    return F.nullif(strip_ws(c), F.lit(""))


def csv_int(c) -> Column:
    """Text to 32-bit int as the CSV loader reads it; NULL on failure."""
    return _try_cast(strip_ws(c), "int")


def _try_cast(col: Column, type_name: str) -> Column:
    return col.try_cast(type_name)


# strptime('%Y-%m-%d %H:%M:%S'): four-digit year, one- or two-digit fields.
_CSV_DATETIME = r"^(\d{4})-(\d{1,2})-(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$"


def csv_timestamp(c) -> Column:
    """P4: 'T' becomes a space, text after the first '.' is cut, then
    ``%Y-%m-%d %H:%M:%S`` is parsed; failure gives NULL (the row is kept).

    Built from the matched parts with ``try_make_timestamp_ntz``, so no
    session time zone is involved (a wall time in a DST gap stays as
    written) and impossible dates (30 February, second 60) give NULL."""
    head = F.split(F.replace(_c(c), F.lit("T"), F.lit(" ")), r"\.").getItem(0)
    part = [F.regexp_extract(head, _CSV_DATETIME, i).try_cast("int") for i in range(1, 7)]
    ok = head.rlike(_CSV_DATETIME) & (part[5] < 60)
    return F.when(ok, F.try_make_timestamp_ntz(*part))


# ISO-8601 date, or date and time to the minute, second or microsecond, without
# a zone: the target column has none.  Anything else (a year alone, one-digit
# parts, signs, zone names or offsets) is rejected before Spark's wider cast.
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"


def iso_timestamp(c) -> Column:
    """P5: ISO-8601 date or date-time to TIMESTAMP_NTZ; NULL on failure or
    when the text carries a zone."""
    col = F.trim(_c(c))
    return F.when(col.rlike(_ISO), _try_cast(col, "timestamp_ntz"))


def iso_string(c) -> Column:
    """``isoformat()`` of a zone-less timestamp: 'T' separator, and the
    six-digit fraction only when microseconds are not zero.  Assembled from
    the NTZ text and fields, so the session time zone plays no part."""
    col = _c(c)
    base = F.replace(F.substring(col.cast("string"), 1, 19), F.lit(" "), F.lit("T"))
    micros = ((F.extract(F.lit("SECOND"), col) * 1_000_000) % 1_000_000).cast("int")
    return F.when(micros == 0, base).otherwise(
        F.concat(base, F.lit("."), F.lpad(micros.cast("string"), 6, "0")))


def year_range(c, year: int) -> Column:
    """``year(ts) = year`` written as a half-open range so the
    bounds reach the Parquet reader as pushed filters."""
    lo = F.lit(f"{int(year):04d}-01-01 00:00:00").cast("timestamp_ntz")
    hi = F.lit(f"{int(year) + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")
    col = _c(c)
    return (col >= lo) & (col < hi)


def signed_label(c) -> Column:
    """Integer with an explicit sign; zero prints as +0."""
    return F.format_string("%+d", _c(c))
