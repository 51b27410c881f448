"""A line of progress on stderr while a job runs: tasks done of those known, and the time that is left at this rate."""

from __future__ import annotations

import contextlib
import sys
import threading
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession


def line(label: str, done: int, total: int, seconds: float) -> str:
    left = f", {seconds * (total - done) / done:.0f} s left" if done else ""
    return f"{label}: {done} of {total} tasks, {100 * done / total if total else 0:.0f} %, {seconds:.0f} s{left}"


@contextlib.contextmanager
def progress(spark: SparkSession, label: str, interval_ms: int) -> Iterator[None]:
    """Writes :func:`line` every ``interval_ms`` milliseconds for the stages that are running; 0 writes nothing."""
    if interval_ms <= 0:
        yield
        return
    tracker, start, stop = spark.sparkContext.statusTracker(), time.monotonic(), threading.Event()

    def watch() -> None:
        while not stop.wait(interval_ms / 1000):
            stages = [s for i in tracker.getActiveStageIds() if (s := tracker.getStageInfo(i))]
            if stages:
                done, total = sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
                print(line(label, done, total, time.monotonic() - start), file=sys.stderr, flush=True)

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        stop.set()
        thread.join()
