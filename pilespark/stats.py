"""Timers and values of a run."""

from __future__ import annotations

import json
import logging
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


class Stats:
    """Named timers and counters; store(spark, path) writes them as one JSON line."""

    def __init__(self):
        self.timers: dict[str, dict[str, float]] = {}
        self.values: dict[str, object] = {}
        self.began: dict[str, float] = {}

    def start(self, name: str) -> None:
        if name in self.timers:
            log.warning("timer %s starts again", name)
        self.timers[name] = {"t0": time.time()}
        self.began[name] = time.perf_counter()

    def stop(self, name: str) -> None:
        timer = self.timers[name]
        timer["t1"] = time.time()
        timer["elapsed"] = time.perf_counter() - self.began.pop(name)  # the wall clock may step back

    @contextmanager
    def timed(self, name: str):
        self.start(name)
        try:
            yield
        finally:
            self.stop(name)

    def set(self, name: str, value: object) -> None:
        self.values[name] = value

    def add(self, name: str, n: int = 1) -> None:
        self.values[name] = self.values.get(name, 0) + n

    def as_dict(self) -> dict:
        return {"timers": self.timers, "values": {k: str(v) for k, v in self.values.items()}}

    def frame(self, spark: SparkSession) -> DataFrame:
        """timer, t0, t1, elapsed."""
        return spark.createDataFrame([(k, t.get("t0"), t.get("t1"), t.get("elapsed")) for k, t in self.timers.items()], "timer string, t0 double, t1 double, elapsed double")

    def store(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(self.as_dict()),)], "value string").coalesce(1).write.mode("overwrite").text(path)
