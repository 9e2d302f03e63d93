"""Progress events and cancellation of a running build."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Progress:
    message: str
    done: int
    total: int


def reporter(spark: SparkSession, tell: Callable[[Progress], None]) -> Callable[[str, int, int], None]:
    """A callback for build_index that also shows as the description of Spark's jobs."""

    def report(message: str, done: int, total: int) -> None:
        spark.sparkContext.setJobDescription(message)
        tell(Progress(message, done, total))

    return report


@contextlib.contextmanager
def cancellable(spark: SparkSession) -> Iterator[str]:
    """Jobs inside belong to one group, whose id is given; cancel(spark, id) from another thread ends them. The live catalog stays."""
    group = f"build-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "index build", interruptOnCancel=True)
    try:
        yield group
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


class Meter:
    """Tasks of a job group, by Spark's status tracker. A stage counts from its first task on, with all its tasks; one that a job skipped never does.
    What was seen stays, also when Spark has forgotten it, so neither number falls."""

    def __init__(self, spark: SparkSession, group: str):
        self.tracker, self.group = spark.sparkContext.statusTracker(), group
        self.stages: dict[int, tuple[int, int]] = {}

    def read(self) -> tuple[int, int]:
        """(tasks done, tasks of the stages known so far)"""
        for job in self.tracker.getJobIdsForGroup(self.group):
            info = self.tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                s = self.tracker.getStageInfo(stage)
                if s and (s.numActiveTasks or s.numCompletedTasks):
                    before = self.stages.get(stage, (0, 0))[0]
                    self.stages[stage] = max(before, min(s.numCompletedTasks, s.numTasks)), s.numTasks
        return sum(d for d, _ in self.stages.values()), sum(t for _, t in self.stages.values())


@contextlib.contextmanager
def metered(spark: SparkSession, tell: Callable[[Progress], None], every: float = 0.5) -> Iterator[Callable[[str, int, int], None]]:
    """A callback for a build inside: its messages go to `tell` with the tasks that Spark has done of those it knows, and so do changes in between.

    The jobs are one group, as in `cancellable`; the callback's attribute `group` is its id. An error of `tell` doesn't end the build."""
    with cancellable(spark) as group:
        meter, lock, over = Meter(spark, group), threading.Lock(), threading.Event()
        last = Progress("", 0, 0)

        def say(message: str | None = None) -> None:
            nonlocal last
            with lock:
                now = Progress(last.message if message is None else message, *meter.read())
                if now != last:
                    last = now
                    with contextlib.suppress(Exception):
                        tell(now)

        def report(message: str, *_: int) -> None:
            spark.sparkContext.setJobDescription(message)
            say(message)

        def watch() -> None:
            while not over.wait(every):
                say()

        report.group = group
        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            yield report
        finally:
            over.set()
            watcher.join()
            say()


def cancel(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)
