"""How long streaming queries run."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql.streaming import StreamingQuery

# Process what is there in as many micro-batches as the source's rate asks for, then end.
DRAIN = {"availableNow": True}
# Start each micro-batch as soon as the one before it ends.
AT_ONCE = {"processingTime": "0 seconds"}


def finish(queries: Sequence[StreamingQuery]) -> None:
    """Wait until draining queries have processed everything; raise what failed."""
    with stopped_on_error(queries):
        for query in queries:
            query.awaitTermination()


def run_for(queries: Sequence[StreamingQuery], seconds: float) -> None:
    """Let running queries work until one common deadline, then stop them all."""
    deadline = time.monotonic() + seconds
    with stopped_on_error(queries):
        for query in queries:
            left = deadline - time.monotonic()
            # Spark waits for whole milliseconds, one at least
            if left >= 0.001:
                query.awaitTermination(left)
        for query in queries:
            if query.exception() is not None:
                raise query.exception()
            query.stop()


@contextmanager
def stopped_on_error(queries: Sequence[StreamingQuery]) -> Iterator[None]:
    """No query is left running behind an error."""
    try:
        yield
    except BaseException:
        for query in queries:
            query.stop()
        raise
