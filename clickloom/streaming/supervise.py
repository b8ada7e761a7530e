"""Restart policy for streaming jobs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StreamingQuery

ATTEMPTS = 10
DELAY_SECONDS = 5.0


def run_with_restarts(
    start: Callable[[], StreamingQuery],
    attempts: int = ATTEMPTS,
    delay_seconds: float = DELAY_SECONDS,
) -> StreamingQuery:
    """Start a query and wait for its end, starting it anew after a failure.

    ``start`` must use a fixed checkpoint, so that each attempt resumes where the last one
    committed. The failure of the last attempt is raised.
    """
    for attempt in range(1, attempts + 1):
        query = start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            if attempt == attempts:
                raise
            time.sleep(delay_seconds)
    raise ValueError("attempts must be at least 1")
