"""Histograms of positions and the position ranges that reducers work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 20_000_000


def position_histogram(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, n."""
    return rows.groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("n"))


def binned_histogram(rows: DataFrame, width: int, *keys: str) -> DataFrame:
    """keys, upper, n over bins that end at multiples of width and, the last, at the highest position; empty bins too."""
    ends = rows.groupBy(*keys).agg(F.max("pos").alias("top"))
    bins = ends.select(*keys, F.explode(F.sequence(F.lit(1), F.ceil(F.col("top") / width))).alias("bin"), "top")
    counted = rows.groupBy(*keys, F.ceil(F.col("pos") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upper = F.least(F.col("bin") * width, F.col("top")).cast("long")
    return bins.join(counted, [*keys, "bin"], "left").select(*keys, upper.alias("upper"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def greedy_bounds(pairs: Column, capacity: int, carry: bool = False) -> Column:
    """Upper ends of the ranges of array<struct<pos, n>>, cut greedily in the order of pos.

    Counts add up while they stay under capacity; at the position that would reach it, the range ends at the position
    before. That position's own count then starts the next range only if carry is set (without it, it is not counted).
    The last position ends the last range.
    """
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("prev"), F.expr("cast(array() as array<bigint>)").alias("ends"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["sum"] + x["n"] < capacity) | acc["prev"].isNull()
        first = F.when((x["n"] < capacity) | F.lit(carry), x["n"]).otherwise(F.lit(0))
        total = F.when(acc["prev"].isNull(), first).when(fits, acc["sum"] + x["n"]).otherwise(x["n"] if carry else F.lit(0))
        return F.struct(total.cast("long").alias("sum"), x["pos"].cast("long").alias("prev"), F.when(fits, acc["ends"]).otherwise(F.array_append(acc["ends"], acc["prev"])).alias("ends"))

    return F.aggregate(F.array_sort(pairs), start, step, lambda acc: F.when(acc["prev"].isNull(), acc["ends"]).otherwise(F.array_append(acc["ends"], acc["prev"])))


def greedy_ranges(histogram: DataFrame, capacity: int = CAPACITY, key: str = "chrom", carry: bool = False) -> DataFrame:
    """key, hi: ends of ranges of under `capacity` rows, from position_histogram(rows, key).

    The rule is sequential, so a key's distinct positions meet in one array; for more than about a million positions a
    key, cumulative_ranges() does the same work without gathering.
    """
    pairs = F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("n").cast("long").alias("n")))
    return histogram.groupBy(key).agg(pairs.alias("pairs")).select(key, F.explode(greedy_bounds(F.col("pairs"), capacity, carry)).alias("hi"))


def cumulative_ranges(histogram: DataFrame, capacity: int = CAPACITY, key: str = "chrom", block: int = 65_536) -> DataFrame:
    """key, hi: ends of ranges of about `capacity` rows, cut where the running count passes multiples of it.

    Running counts come from blocks of positions: their totals are summed by a window over blocks only, then within each
    block, so no key's positions meet in one task.
    """
    blocks = histogram.withColumn("block", F.floor(F.col("pos") / block))
    totals = blocks.groupBy(key, "block").agg(F.sum("n").alias("total"))
    before = totals.withColumn("before", F.sum("total").over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select(key, "block", F.coalesce("before", F.lit(0)).alias("before"))
    running = F.sum("n").over(Window.partitionBy(key, "block").orderBy("pos"))
    parts = blocks.withColumn("running", running).join(before, [key, "block"]).withColumn("part", F.floor((F.col("before") + F.col("running") - 1) / capacity))
    return parts.groupBy(key, "part").agg(F.max("pos").cast("long").alias("hi")).select(key, "hi")


def reducer_tasks(ranges: DataFrame, key: str = "chrom") -> DataFrame:
    """key, part, lo, hi: each range with its number and where it starts, the first at 1."""
    w = Window.partitionBy(key).orderBy("hi")
    return ranges.select(key, F.row_number().over(w).alias("part"), (F.lag("hi", 1, 0).over(w) + 1).alias("lo"), "hi")
