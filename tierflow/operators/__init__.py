"""DataFrame forms of the operators pipelines are built from."""

from .aggregates import first_rows, revenue_by, roll_up, summarize
from .asof import asof_join
from .cubes import cube, lattice, rollup
from .distinct import distinct_counts, distinct_sketches, estimated, rolled_up
from .history import latest, latest_stream, versions_from_changes, with_load_columns
from .joins import broadcast_fits, temporal_left_join
from .percentiles import exact_percentile_bounds, percentile_bounds, trim_outliers
from .running import running_total
from .sessions import sessions
from .trips import curate_trips, derive_trips, summarize_trips, trim_trips

__all__ = [
    "asof_join",
    "broadcast_fits",
    "cube",
    "curate_trips",
    "derive_trips",
    "distinct_counts",
    "distinct_sketches",
    "estimated",
    "exact_percentile_bounds",
    "first_rows",
    "latest",
    "latest_stream",
    "lattice",
    "percentile_bounds",
    "revenue_by",
    "roll_up",
    "rolled_up",
    "rollup",
    "running_total",
    "sessions",
    "summarize",
    "summarize_trips",
    "temporal_left_join",
    "trim_outliers",
    "trim_trips",
    "versions_from_changes",
    "with_load_columns",
]
