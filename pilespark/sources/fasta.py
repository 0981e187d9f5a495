"""FASTA files: contigs, their offsets, and byte ranges of them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import header_name
from .blocks import before_block, read_blocks, with_blocks


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """contig, description, seq, ord (growing) of a FASTA file, by the text reader with records for lines.

    A record is one row, so this is for files whose contigs fit a task; read_lines() has no such bound.
    """
    records = spark.read.option("lineSep", "\n>").text(path).withColumn("ord", F.monotonically_increasing_id())
    parts = F.split(F.regexp_replace("value", "^>", ""), "\n", 2)
    head, body = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    return records.where(F.length(F.trim("value")) > 0).select(header_name(head).alias("contig"), F.trim(F.regexp_replace(head, r"^\S+\s*", "")).alias("description"), F.regexp_replace(body, r"\s", "").alias("seq"), "ord")


def contig_names(lines: DataFrame) -> DataFrame:
    """contig, n of lines(contig): sequences and how many lines each has."""
    return lines.groupBy("contig").agg(F.count(F.lit(1)).alias("n"))


def scanned_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, offset (bytes from the block's first line), size (bytes), header, contig, line, of every line.

    contig is the last header's within the block, or null where the contig began in an earlier block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place, contig = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (file[1:] != file[:-1])) + 1
            for b, e in pairwise([0, *cuts.tolist(), batch.num_rows]):
                part = batch.slice(b, e - b)
                if (file[b], block[b]) != at:
                    at, place, contig = (file[b], block[b]), 0, None
                line = part.column(2)
                size = pc.binary_length(line).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                header = pc.starts_with(line, ">")
                name = pc.struct_field(pc.extract_regex(line, r"^>\s*(?P<name>\S*)"), [0])
                name = pc.fill_null_forward(pc.if_else(header, name, pa.scalar(None, name.type)))
                if contig is not None:
                    name = pc.fill_null(name, contig)
                ends = place + np.cumsum(size)
                place, contig = int(ends[-1]), name[-1].as_py()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ends - size), pa.array(size), header, name, pc.utf8_rtrim(line, "\r")], names=["file", "block", "offset", "size", "header", "contig", "line"])

    return read_blocks(spark, path).mapInArrow(run, "file string, block long, offset long, size long, header boolean, contig string, line string")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, offset (in the file), size (bytes), header, contig, line of every line, whichever block its contig's header is in."""
    rows = scanned_lines(spark, path)
    # one row for each block: its bytes and its last header, carried to the blocks after it
    last = F.max_by("contig", F.when(F.col("contig").isNotNull(), F.col("offset")))
    sizes = rows.groupBy("file", "block").agg(F.sum("size").alias("bytes"), last.alias("last"))
    blocks = sizes.select("file", "block", F.coalesce(F.sum("bytes").over(before_block()), F.lit(0)).alias("base"), F.last("last", ignorenulls=True).over(before_block()).alias("carried"))
    return with_blocks(rows, blocks).select("file", (F.col("base") + F.col("offset")).alias("offset"), "size", "header", F.coalesce("contig", "carried").alias("contig"), "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, contig, offset, line of every sequence line of FASTA files, on any store that Spark reads, block by block."""
    return placed_lines(spark, path).where("not header and line <> ''").select("file", "contig", "offset", "line")


def faidx(spark: SparkSession, path: str) -> DataFrame:
    """file, contig, offset_head, offset_base: where each header begins, and the bases after it."""
    heads = placed_lines(spark, path).where("header")
    return heads.select("file", "contig", F.col("offset").alias("offset_head"), (F.col("offset") + F.col("size")).alias("offset_base"))


def write_fasta(contigs: DataFrame, path: str, width: int = 60) -> None:
    """contigs(contig, seq, ord) as text, wrapped, in the order of ord."""
    wrapped = F.array_join(F.regexp_extract_all("seq", F.lit(f"(.{{1,{width}}})"), F.lit(1)), "\n")
    contigs.orderBy("ord").select(F.concat(F.lit(">"), "contig", F.lit("\n"), wrapped).alias("value")).write.mode("overwrite").text(path)
