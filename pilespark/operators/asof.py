"""Nearest-row lookups by order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, at: str, by: tuple[str, ...], values: tuple[str, ...], forward: bool = False, tie: Column | None = None) -> DataFrame:
    """left with the `values` of the last row of right (same `by`) at or before `at`; forward: the first at or after.

    Both sides meet in one shuffle on `by` and a running window, instead of a join over an inequality. Without `by`, `at`
    is cut into ranges, a task each, and what the ranges before hold is carried on as one row a range. `tie` orders right
    rows of one `at`; the last of them (forward: the first) counts. Left rows without a partner, or with a null in `at` or
    `by`, get nulls.
    """
    tie = F.lit(0) if tie is None else tie
    hit = F.struct(*values)
    b = right.select(*by, at, F.lit(1 if forward else 0).alias("_side"), tie.cast("long").alias("_tie"), hit.alias("_hit")).dropna(subset=[*by, at])
    a = left.withColumns({"_side": F.lit(0 if forward else 1), "_tie": F.lit(None).cast("long"), "_hit": F.lit(None).cast(b.schema["_hit"].dataType)})
    cuts = [] if by else _cuts(a.select(at).union(b.select(at)), at)
    a, b = (x.withColumn("_range", _below(F.col(at), cuts)) for x in (a, b))
    both = a.unionByName(b, allowMissingColumns=True)
    # a frame that ends in the current row is one pass; one that begins there would be a pass for each row
    turned = [F.col(at).desc_nulls_first(), F.desc("_side"), F.desc("_tie")] if forward else [at, "_side", "_tie"]
    w = Window.partitionBy(*by, "_range").orderBy(*turned).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_hit", ignorenulls=True).over(w)).where(F.col("_side") == (0 if forward else 1))
    if cuts:
        found = found.join(F.broadcast(_carried(b, at, len(cuts) + 1, forward)), "_range", "left").withColumn("_found", F.when(F.col(at).isNotNull(), F.coalesce("_found", "_before")))
    return found.select(*left.columns, *(F.col("_found").getField(v).alias(f"{v}_asof") for v in values))


def _cuts(rows: DataFrame, at: str) -> list:
    """Values that cut rows(at) into about as many ranges of a like size as a shuffle has partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx(at, [i / n for i in range(1, n)] or [0.5])).first()[0]
    return sorted(set(found or []))


def _below(value: Column, cuts: list) -> Column:
    """Number of cuts less than value, as a tree of comparisons; 0 for a null."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > F.lit(cuts[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def _carried(b: DataFrame, at: str, n: int, forward: bool) -> DataFrame:
    """_range, _before: the hit that the ranges before each of n (forward: after it) end (begin) with; n rows."""
    end = (F.min_by if forward else F.max_by)("_hit", F.struct(at, "_tie"))
    held = b.groupBy("_range").agg(end.alias("x"))
    rows = b.sparkSession.range(n).select(F.col("id").cast("int").alias("_range")).join(F.broadcast(held), "_range", "left")
    w = Window.orderBy(F.desc("_range") if forward else "_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    return rows.select("_range", F.last("x", ignorenulls=True).over(w).alias("_before"))


def line_ranges(pairs: DataFrame, windows: DataFrame, file_size: int) -> DataFrame:
    """pairs(line_0, line_1) with the compressed bytes range_0, range_1 that hold these lines.

    windows(line_number, compressed_byte) index a file sparsely: a range starts at the last window at or before line_0
    (else at 0) and ends at the first window at or after line_1 (else at the end). Both ends are as-of lookups, so the time
    is that of two sorts, however long the index.
    """
    at = lambda line: windows.select(F.col("line_number").cast("long").alias(line), F.col("compressed_byte").cast("long").alias("byte"))
    found = as_of(pairs, at("line_0"), "line_0", (), ("byte",), tie=F.col("byte")).withColumnRenamed("byte_asof", "range_0")
    found = as_of(found, at("line_1"), "line_1", (), ("byte",), forward=True, tie=F.col("byte"))
    return found.select(*pairs.columns, F.coalesce("range_0", F.lit(0)).cast("long").alias("range_0"), F.coalesce("byte_asof", F.lit(file_size)).cast("long").alias("range_1"))


def nearest(windows: DataFrame, line: int) -> DataFrame:
    """The window whose line_number is nearest (the lower one of two as near)."""
    return windows.agg(F.min_by("window", F.struct(F.abs(F.col("line_number") - line), "line_number")).alias("window"))
