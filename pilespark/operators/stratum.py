"""Reconciling a read's alignments across reference chunks by their best stratum.

Frames of map records have the columns read_id, fasta_chunk, name, seq, qual, summary, alignments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strata import alignments_within, best_stratum, first_alignments


def is_mapped():
    return F.col("alignments") != "-"


def has_stratum():
    """Whether the summary's first part counts an alignment; others are unlikely matches."""
    return F.element_at(F.split("summary", r"\+"), 1).rlike("[1-9]")


def index_reads(records: DataFrame) -> DataFrame:
    """Mapped records with their best stratum, idx; unmapped and unlikely ones go."""
    return records.where(is_mapped() & has_stratum()).withColumn("idx", best_stratum(F.col("summary")))


def best_per_read(index: DataFrame, keys: tuple[str, ...] = ("read_id",), least_chunks: int = 2) -> DataFrame:
    """keys, best, n_chunks of reads that least_chunks reference chunks report: one partial and one final aggregate."""
    return index.groupBy(*keys).agg(F.min("idx").cast("int").alias("best"), F.count(F.lit(1)).alias("n_chunks")).where(F.col("n_chunks") >= least_chunks)


def merge_indexes(left: DataFrame, right: DataFrame, key: str = "read_id") -> DataFrame:
    """key, best, in_both: two chunks' indexes (key, idx) merged by a full outer join."""
    a, b = left.select(key, F.col("idx").alias("a")), right.select(key, F.col("idx").alias("b"))
    return a.join(b, key, "full_outer").select(key, F.least("a", "b").cast("int").alias("best"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("in_both"))


def correct(records: DataFrame, best: DataFrame, tolerance: int = 0, keys: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """Indexed records held against the reads' best strata over all chunks.

    A record whose stratum is more than `tolerance` worse than the best goes. The others keep the alignments of the
    strata up to the best (their own, if the read has no common best) plus tolerance. Adds threshold and n_alignments.
    """
    joined = records.join(best.select(*keys, "best"), list(keys), "left")
    kept = joined.where(F.col("best").isNull() | (F.col("idx") <= F.col("best") + tolerance))
    kept = kept.withColumn("threshold", F.coalesce(F.col("best"), F.col("idx")) + tolerance)
    kept = kept.withColumn("n_alignments", alignments_within(F.col("summary"), F.col("threshold")))
    return kept.withColumn("alignments", first_alignments(F.col("alignments"), F.col("n_alignments"))).drop("best")


def quality_counters(records: DataFrame, *by: str) -> DataFrame:
    """n_total, n_no_match, n_unlikely, n_kept; the last three add up to the first."""
    count = lambda c, name: F.count_if(c).alias(name)
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), count(~is_mapped(), "n_no_match"), count(is_mapped() & ~has_stratum(), "n_unlikely"), count(is_mapped() & has_stratum(), "n_kept"))


def correction_counters(records: DataFrame, best: DataFrame, tolerance: int = 0, keys: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """One row: records without a common best, kept at or within tolerance of it, discarded, and the shares in millionths."""
    joined = records.join(best.select(*keys, "best"), list(keys), "left")
    over = F.col("idx") > F.col("best") + tolerance
    counted = joined.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("best").isNull()).alias("n_single"),
        F.count_if(F.col("idx") == F.col("best")).alias("n_best"),
        F.count_if((F.col("idx") > F.col("best")) & ~over).alias("n_tolerated"),
        F.count_if(over).alias("n_discarded"),
    )
    share = lambda c: F.when(F.col("n_total") > 0, F.floor(F.col(c) * 1_000_000 / F.col("n_total"))).otherwise(0).cast("long")
    return counted.withColumns({"n_filtered": F.col("n_total") - F.col("n_discarded"), "discarded_ppm": share("n_discarded")})
