"""Date, time and arithmetic expressions over text timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Timestamp text in and minute text out.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
MINUTE_FORMAT = "yyyy-MM-dd HH:mm:00"
SECONDS_PER_HOUR = 3600
SLOT_MINUTES = 10

ColumnOrName = Column | str


def _column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _parsed(text: ColumnOrName, format: str) -> Column:
    return F.try_to_timestamp(_column(text), F.lit(format))


def to_day(text: ColumnOrName, format: str = TIMESTAMP_FORMAT) -> Column:
    """Date of a text timestamp."""
    return _parsed(text, format).cast("date")


def unix_seconds(text: ColumnOrName, format: str = TIMESTAMP_FORMAT) -> Column:
    """Seconds since the epoch (bigint) of a text timestamp."""
    return F.unix_seconds(_parsed(text, format))


def duration_seconds(
    start: ColumnOrName, end: ColumnOrName, format: str = TIMESTAMP_FORMAT
) -> Column:
    """Seconds from ``start`` to ``end``, negative if they are swapped."""
    return unix_seconds(end, format) - unix_seconds(start, format)


def minute_text(text: ColumnOrName, format: str = TIMESTAMP_FORMAT) -> Column:
    """Text of the minute a timestamp falls in."""
    return F.date_format(_parsed(text, format), MINUTE_FORMAT)


def hour_of(text: ColumnOrName) -> Column:
    """Hour (int) of anything that casts to a timestamp."""
    return F.hour(_column(text).try_cast("timestamp"))


def minute_of(text: ColumnOrName) -> Column:
    return F.minute(_column(text).try_cast("timestamp"))


def time_slot(text: ColumnOrName, minutes: int = SLOT_MINUTES) -> Column:
    """Number (bigint) of the slot within the hour."""
    return F.floor(minute_of(text) / F.lit(minutes))


def safe_divide(dividend: ColumnOrName, divisor: ColumnOrName) -> Column:
    """Quotient, NULL where the divisor is zero."""
    return F.try_divide(_column(dividend), _column(divisor))


def speed_per_hour(distance: ColumnOrName, seconds: ColumnOrName) -> Column:
    """Distance per hour to two decimals, NULL for a zero duration."""
    return F.round(safe_divide(distance, seconds) * F.lit(SECONDS_PER_HOUR), 2)
