"""One operation at a time, with progress and a way to stop it."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import SparkSession

R = TypeVar("R")


class Busy(RuntimeError):
    """Another operation is under way."""


class Stopped(RuntimeError):
    """An operation was cancelled before it had anything to show."""


@dataclass
class Progress:
    """What an operation has done so far."""

    stage: str = ""
    counts: dict[str, int] = field(default_factory=dict)


class Control:
    """Runs operations in a job group of their own; they never overlap."""

    def __init__(self, spark: SparkSession, listen: Callable[[Progress], None] = lambda p: None):
        self.spark, self.listen, self.progress = spark, listen, Progress()
        self._lock, self._group, self._stop = threading.Lock(), "docweir", threading.Event()

    def report(self, stage: str, **counts: int) -> None:
        self.progress = Progress(stage, {**self.progress.counts, **counts})
        self.listen(self.progress)

    @property
    def stopped(self) -> bool:
        """Operations ask this between two labels, and between two batches of articles."""
        return self._stop.is_set()

    def run(self, name: str, operation: Callable[[Control], R]) -> R:
        if not self._lock.acquire(blocking=False):
            raise Busy(f"{name} has to wait for another operation")
        try:
            self._stop.clear()
            self.progress = Progress()
            self.spark.sparkContext.setJobGroup(self._group, name, interruptOnCancel=True)
            self.report("started")
            return operation(self)
        except Exception as e:
            if self.stopped:
                raise Stopped(name) from e
            raise
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            self._lock.release()
            self.report("stopped" if self.stopped else "ended")

    def each(self, labels: list[str], operation: Callable[[str], R]) -> list[R]:
        """The operation for one label after the other, until it is stopped."""
        out = []
        for k, label in enumerate(labels):
            if self.stopped:
                break
            out.append(operation(label))
            self.report(label, done=k + 1, total=len(labels))
        return out

    def stop(self) -> None:
        """Ends the operation after what it has at hand."""
        self._stop.set()

    def cancel(self) -> None:
        """Ends the operation now: jobs that run are killed, and the operation drops what they have not ended."""
        self._stop.set()
        self.spark.sparkContext.cancelJobGroup(self._group)
