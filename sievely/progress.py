"""Progress on a terminal: how many tasks of the stages at work are done. Nothing is written anywhere else."""

from __future__ import annotations

import sys
import threading
from typing import TextIO

from pyspark.sql import SparkSession


class Progress:
    """with Progress(spark): .. - a line on stderr that is written anew while jobs run and removed at the end; silent where stderr is no terminal."""

    def __init__(self, spark: SparkSession, stream: TextIO | None = None, every: float = 0.2):
        self.tracker, self.stream, self.every = spark.sparkContext.statusTracker(), stream or sys.stderr, every
        self._over, self._shown = threading.Event(), ""
        self._thread = threading.Thread(target=self._run, daemon=True)

    def counts(self) -> tuple[int, int]:
        """Tasks that are done, and all tasks, of the stages at work."""
        stages = [info for k in self.tracker.getActiveStageIds() if (info := self.tracker.getStageInfo(k))]
        return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)

    def _show(self, text: str) -> None:
        if text != self._shown:
            self.stream.write("\r" + text.ljust(len(self._shown)) + ("" if text else "\r"))
            self.stream.flush()
            self._shown = text

    def _run(self) -> None:
        while not self._over.wait(self.every):
            done, all_ = self.counts()
            if all_:
                self._show(f"{done}/{all_} tasks")

    def __enter__(self) -> Progress:
        if self.stream.isatty():
            self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._over.set()
        if self._thread.is_alive():
            self._thread.join()
        self._show("")
