"""Reports of a stream's progress, and restarts of one that stands still or fails."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

REPORT_SECONDS, STALL_SECONDS = 4.0, 60.0


class Progress(StreamingQueryListener):
    """Keeps each micro-batch of one checkpointed stream, and tells a callback: (batch, rows, rows per second)."""

    def __init__(self, tell: Callable[[int, int, float], None] | None = None):
        self.batches: dict[int, int] = {}
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches[p.batchId] = max(p.numInputRows, self.batches.get(p.batchId, 0))
        if self.tell:
            self.tell(p.batchId, p.numInputRows, p.processedRowsPerSecond or 0.0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def supervise(start: Callable[[], StreamingQuery], stall: float = STALL_SECONDS, restarts: int = 5, report: Callable[[dict], None] | None = None, every: float = REPORT_SECONDS) -> StreamingQuery:
    """Runs start() until its stream ends by itself; after a failure, or `stall` seconds without progress, starts it again.

    The stream's checkpoint makes it go on where it was.  After `restarts` of them the last failure is raised.
    """
    for attempt in range(restarts + 1):
        stream = start()
        moved, last = time.monotonic(), None
        try:
            while not stream.awaitTermination(every):
                now = stream.lastProgress
                mark = now and (now["batchId"], now["timestamp"])
                if mark != last:
                    moved, last = time.monotonic(), mark
                if report:
                    report({"attempt": attempt, "status": stream.status["message"], "batch": now["batchId"] if now else None})
                if time.monotonic() - moved > stall:
                    stream.stop()
                    raise TimeoutError(f"no progress for {stall} seconds")
            return stream
        except Exception:
            if attempt == restarts:
                raise
    raise AssertionError("unreachable")
