"""Streaming sinks and how long their queries run."""

from .joins import interval_join
from .queries import AT_ONCE, DRAIN, finish, run_for
from .sinks import default_output_mode, has_stored, start_sinks, stored_stream
from .versions import versions_of_stream
from .windows import EventWindows

__all__ = [
    "AT_ONCE",
    "DRAIN",
    "EventWindows",
    "default_output_mode",
    "finish",
    "has_stored",
    "interval_join",
    "run_for",
    "start_sinks",
    "stored_stream",
    "versions_of_stream",
]
