"""Match summaries: counts of alignments by stratum, such as `0:1:2+0:1`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strata(summary: Column) -> Column:
    """Counts of the part before the first `+`, best stratum first."""
    return F.split(F.element_at(F.split(summary, r"\+"), 1), ":").cast("array<int>")


def best_stratum(summary: Column) -> Column:
    """1-based number of the first stratum that has alignments; 0 if none has."""
    return F.array_position(F.transform(strata(summary), lambda n: n > 0), True).cast("int")


def alignments_within(summary: Column, threshold: Column) -> Column:
    """How many alignments the first `threshold` strata have."""
    return F.aggregate(F.slice(strata(summary), F.lit(1), F.greatest(threshold, F.lit(0))), F.lit(0), lambda total, n: total + n)


def first_alignments(alignments: Column, k: Column) -> Column:
    """The first k entries of a comma-separated list, joined again."""
    return F.array_join(F.slice(F.split(alignments, ","), F.lit(1), F.greatest(k, F.lit(0))), ",")
