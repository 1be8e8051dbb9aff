"""A run's context: cancelling its Spark jobs, a time limit, and notes about it."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    pass


class TimedOut(Cancelled):
    pass


class RunContext:
    """Use as a context manager around actions: jobs started inside carry a tag, cancel() ends them."""

    def __init__(self, spark: SparkSession, timeout: float | None = None):
        self.spark, self.tag = spark, f"run-{uuid.uuid4().hex}"
        self._began, self._meta, self._lock, self._done = time.monotonic(), {}, threading.Lock(), threading.Event()
        self._error: Cancelled | None = None
        self._timer = threading.Timer(timeout, self._end, [TimedOut("the run took too long")]) if timeout is not None else None
        if self._timer:
            self._timer.daemon = True
            self._timer.start()

    def __enter__(self) -> RunContext:
        self.spark.sparkContext.addJobTag(self.tag)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext.removeJobTag(self.tag)
        if self._timer:
            self._timer.cancel()

    def _end(self, error: Cancelled) -> None:
        with self._lock:
            self._error = self._error or error
        self._done.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def cancel(self) -> None:
        self._end(Cancelled("the run was cancelled"))

    def done(self) -> threading.Event:
        return self._done

    def err(self) -> Cancelled | None:
        return self._error

    def set(self, key: str, value: str) -> None:
        with self._lock:
            self._meta[key] = value

    def get(self, key: str) -> str | None:
        with self._lock:
            return self._meta.get(key)

    def snapshot(self) -> dict[str, str]:
        with self._lock:
            return dict(self._meta)

    def elapsed(self) -> float:
        return time.monotonic() - self._began
