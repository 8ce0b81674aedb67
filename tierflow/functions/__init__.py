"""Column functions the pipelines use; all are built-in expressions.

Text that does not parse and division by zero give NULL, with ANSI mode on or
off, so one bad cell never fails a job.
"""

from .scalars import (
    duration_seconds,
    hour_of,
    minute_of,
    minute_text,
    safe_divide,
    speed_per_hour,
    time_slot,
    to_day,
    unix_seconds,
)

__all__ = [
    "duration_seconds",
    "hour_of",
    "minute_of",
    "minute_text",
    "safe_divide",
    "speed_per_hour",
    "time_slot",
    "to_day",
    "unix_seconds",
]
