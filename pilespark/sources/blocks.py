"""Text files of any store that Spark reads, with what a line's place in its whole file is.

Files are read in blocks, each by a task of its own. What lies before a block is summed over blocks, one row each, so
numbering lines moves no line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blocks that may be broadcast: some 200 bytes each.
BROADCAST_BLOCKS = 200_000


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """file, block (byte at which it begins), line: lines end at a line feed and are in the order of their block.

    A block's size follows spark.sql.files.maxPartitionBytes; a compressed file is one block.
    """
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def before_block():
    """The blocks of a file before a block."""
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def with_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows with the columns of their block; blocks are counted before they are broadcast."""
    few = blocks.count() <= BROADCAST_BLOCKS
    return rows.join(F.broadcast(blocks) if few else blocks, ["file", "block"])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1 in each file), line."""
    rows = read_blocks(spark, path).withColumn("id", F.monotonically_increasing_id())
    sizes = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    blocks = sizes.select("file", "block", (F.coalesce(F.sum("n").over(before_block()), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    return with_blocks(rows, blocks).select("file", (F.col("id") + F.col("shift")).alias("line_no"), "line")


def zip_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """line_no, a, b: the lines(line_no, line) of two files side by side; the shorter one ends with nulls."""
    left, right = (x.select("line_no", F.col("line").alias(name)) for x, name in ((a, "a"), (b, "b")))
    return left.join(right, "line_no", "full")
