"""Pileups as tables and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "chrom string, pos long, ref string, depth long, bases string, quals string"


def write_pileups(rows: DataFrame, path: str, *by: str) -> None:
    """Parquet, partitioned by chrom (and `by`), sorted by position within files so that position filters skip row groups."""
    keys = [*by, "chrom"]
    rows.repartition(*keys, F.floor(F.col("pos") / 10_000_000)).sortWithinPartitions(*keys, "pos").write.mode("overwrite").partitionBy(*keys).option("compression", "zstd").parquet(path)


def read_pileups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_text(rows: DataFrame, path: str, single_file: bool = False) -> None:
    """Tab-separated lines ordered by chrom and pos, nothing quoted, for qualities hold any printable character."""
    ordered = rows.select("chrom", "pos", "ref", "depth", "bases", "quals").orderBy("chrom", "pos", "ref")
    lines = ordered.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "ref", F.col("depth").cast("string"), "bases", "quals").alias("value"))
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Text pileups; a seventh, empty field of raw rows is dropped."""
    f = F.split("value", "\t")
    types = [c.rsplit(" ", 1) for c in SCHEMA.split(", ")]
    return spark.read.text(path).select(*(F.get(f, F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(types)))


def histogram_lines(histogram: DataFrame) -> DataFrame:
    """`upper:n` lines of a binned histogram, in order."""
    return histogram.orderBy("upper").select(F.concat_ws(":", F.col("upper").cast("string"), F.col("n").cast("string")).alias("value"))


def write_histogram(histogram: DataFrame, path: str) -> None:
    """The same lines as text; bins are few, so one file keeps their order."""
    histogram_lines(histogram).coalesce(1).write.mode("overwrite").text(path)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """upper, n of `upper:n` lines."""
    f = F.split("value", ":")
    return spark.read.text(path).select(F.get(f, F.lit(0)).cast("long").alias("upper"), F.get(f, F.lit(1)).cast("long").alias("n"))
