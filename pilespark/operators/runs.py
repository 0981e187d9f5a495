"""What runs took: seconds, transfers and cost by stage, and intervals between events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deltas(events: DataFrame, ts: Column, by: str, *order: str) -> DataFrame:
    """events with delta: ts less that of the event before, of the same `by`; null for the first."""
    w = Window.partitionBy(by).orderBy(ts, *order)
    return events.withColumn("delta", ts - F.lag(ts).over(w))


def stage_cost(spent: DataFrame, amount: Column, rate: Column, by: str = "stage") -> DataFrame:
    """by, cost: sums of amount x rate by stage, and the total in a row with a null stage."""
    return spent.rollup(by).agg(F.sum(amount * rate).alias("cost"))


def compute_cost(functions: DataFrame, rate: float, by: str = "stage") -> DataFrame:
    """functions(stage, t0, t1) -> seconds and cost by stage, and in total."""
    return functions.rollup(by).agg(F.sum(F.col("t1") - F.col("t0")).alias("seconds"), F.sum((F.col("t1") - F.col("t0")) * rate).alias("cost"))


def scan_cost(scanned: DataFrame, per_gb: float = 0.002, per_unit: float = 0.0007, by: str = "stage") -> DataFrame:
    """scanned(stage, bytes_scanned, kb_returned) -> cost of scanned gigabytes and of returned units of 1000 KB."""
    return scanned.rollup(by).agg(F.sum(F.col("bytes_scanned") / 1e9 * per_gb + F.col("kb_returned") / 1000 * per_unit).alias("cost"))


def transfers(sizes: DataFrame, by: str = "stage", amount: str = "bytes") -> DataFrame:
    """by, n, total, mean (whole), share_ppm: what each stage moves, and its share of all."""
    each = sizes.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).cast("long").alias("total"))
    whole = F.sum("total").over(Window.partitionBy(F.lit(0)))  # one row for each stage
    return each.select(by, "n", "total", F.floor(F.col("total") / F.col("n")).cast("long").alias("mean"), F.when(whole > 0, F.floor(F.col("total") * 1_000_000 / whole)).otherwise(0).cast("long").alias("share_ppm"))


def phase_seconds(functions: DataFrame, stages: list[str], phase: str = "phase", stage: str = "stage", seconds: str = "seconds") -> DataFrame:
    """phase, then a column for each of `stages`: seconds by phase and stage."""
    return functions.groupBy(phase).pivot(stage, stages).agg(F.sum(seconds)).na.fill(0)


def function_counts(functions: DataFrame, stages: list[str], phase: str = "phase", stage: str = "stage") -> DataFrame:
    """The same for how many functions ran."""
    return functions.groupBy(phase).pivot(stage, stages).agg(F.count(F.lit(1))).na.fill(0)


def write_costs(costs: DataFrame, path: str) -> None:
    costs.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
