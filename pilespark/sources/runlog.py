"""Run logs: the nested JSON of earlier runs, and the statistics that this engine writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETAIL = "struct<timestamps: map<string, double>, data_sizes: map<string, double>, execution_time: double>"
STAGES = f"map<string, struct<function_details: array<map<string, {DETAIL}>>>>"
LEGACY = f"map<string, map<string, map<string, struct<phases: {STAGES}>>>>"
STATS = "struct<timers: map<string, struct<t0: double, t1: double, elapsed: double>>, values: map<string, string>>"


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """phase, step, stage, fn, execution_time, event, ts and name, bytes of each function of a nested run log.

    A function's timestamps and sizes are arrays of structs: timestamps(event, ts), data_sizes(name, bytes).
    """
    log = spark.read.text(path, wholetext=True).select(F.from_json("value", LEGACY).alias("log"))
    phases = log.select(F.explode(F.element_at("log", "pipeline")).alias("phase", "steps"))
    steps = phases.select("phase", F.explode("steps").alias("step", "body")).select("phase", "step", F.explode("body.phases").alias("stage", "s"))
    functions = steps.select("phase", "step", "stage", F.explode("s.function_details").alias("f")).select("phase", "step", "stage", F.explode("f").alias("fn", "d"))
    pairs = lambda c, a, b: F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias(a), e["value"].alias(b)))
    return functions.select("phase", "step", "stage", "fn", F.col("d.execution_time").alias("execution_time"), pairs("d.timestamps", "event", "ts").alias("timestamps"), pairs("d.data_sizes", "name", "bytes").alias("data_sizes"))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """timer, t0, t1, elapsed of the statistics that stats.Timers writes."""
    stats = spark.read.text(path, wholetext=True).select(F.from_json("value", STATS).alias("s"))
    return stats.select(F.explode("s.timers").alias("timer", "t")).select("timer", "t.*")
