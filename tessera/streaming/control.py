"""Progress and cancellation of running work."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Passes a query's progress on, at most every ``seconds`` but always at its end."""

    def __init__(self, report: Callable[[str, int, int], None], seconds: float = 2.0, clock: Callable[[], float] = time.monotonic):
        self.report, self.seconds, self.clock = report, seconds, clock
        self.last: dict[str, float] = {}
        self.rows: dict[str, int] = {}

    def offer(self, run: str, batch: int, rows: int, forced: bool = False) -> bool:
        """Add a batch's rows and report if it is time; whether it was."""
        self.rows[run] = self.rows.get(run, 0) + rows
        now = self.clock()
        if not forced and now - self.last.get(run, float("-inf")) < self.seconds:
            return False
        self.last[run] = now
        self.report(run, batch, self.rows[run])
        return True

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.offer(str(p.runId), p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.offer(str(event.runId), -1, 0, forced=True)


def tagged(spark: SparkSession, run: str):
    """Mark what this thread starts as part of a run, so that :func:`cancel` ends it."""
    spark.addTag(run)
    return spark


def cancel(spark: SparkSession, run: str) -> list[str]:
    return spark.interruptTag(run)
