"""Merging base observations into pileups, and what is counted by position.

Observations and pileups have the columns chrom, pos, ref, depth, bases, quals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_pileups(rows: DataFrame) -> DataFrame:
    """One row for each (chrom, pos, ref): depths summed, bases and qualities joined in the order of (bases, quals).

    Partial pileups merge into the same multiset of observations as the raw rows; the aggregate is partial before its
    one shuffle. A position so deep that its strings do not fit a task is a case for base_counts().
    """
    joined = lambda c: F.expr(f"listagg({c}, '') within group (order by bases, quals)").alias(c)
    return rows.groupBy("chrom", "pos", "ref").agg(F.sum("depth").cast("long").alias("depth"), joined("bases"), joined("quals"))


def base_counts(rows: DataFrame) -> DataFrame:
    """(chrom, pos, ref): how many observations match, show each base, delete, insert and end in a deletion.

    Counts only, so any depth at a position is a fixed-size row in the shuffle.
    """
    first = F.upper(F.substr("bases", F.lit(1), F.lit(1)))
    observed = F.when(first.isin(".", ","), F.col("ref")).otherwise(first)
    return rows.groupBy("chrom", "pos", "ref").agg(
        F.count(F.lit(1)).alias("depth"),
        F.count_if(first.isin(".", ",")).alias("n_ref"),
        *(F.count_if(observed == b).alias(f"n_{b.lower()}") for b in "ACGT"),
        F.count_if(first == "*").alias("n_deleted"),
        F.count_if(F.substr("bases", F.lit(2), F.lit(1)) == "+").alias("n_insertion"),
        F.count_if(F.substr("bases", F.lit(2), F.lit(1)) == "-").alias("n_deletion"),
    )


def call_variants(counts: DataFrame, least_depth: int = 4, least_count: int = 2, least_ppm: int = 200_000) -> DataFrame:
    """Positions of base_counts() whose commonest other base is frequent enough: alt, alt_count, freq_ppm.

    Ties go to the first of A, C, G, T. The rule takes the place of an external caller whose statistics are not public.
    """
    other = F.array(*(F.struct(F.when(F.upper("ref") == b, -1).otherwise(F.col(f"n_{b.lower()}")).alias("n"), F.lit(-i).alias("order"), F.lit(b).alias("alt")) for i, b in enumerate("ACGT")))
    top = counts.withColumn("top", F.array_max(other))
    called = top.select("chrom", "pos", "ref", "depth", F.col("top.alt").alias("alt"), F.col("top.n").cast("long").alias("alt_count"), F.floor(F.col("top.n") * 1_000_000 / F.col("depth")).cast("long").alias("freq_ppm"))
    return called.where((F.col("depth") >= least_depth) & (F.col("alt_count") >= least_count) & (F.col("freq_ppm") >= least_ppm))


def scan_range(pileups: DataFrame, low: int, high: int) -> DataFrame:
    """Rows with low <= pos <= high; a Parquet scan takes the bounds as pushed filters."""
    return pileups.where(F.col("pos").between(low, high))


def duplicate_positions(rows: DataFrame) -> DataFrame:
    """Rows of positions that occur more than once."""
    return rows.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("chrom", "pos"))).where("times > 1")


def union_parts(*parts: DataFrame) -> DataFrame:
    """All rows of all parts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
