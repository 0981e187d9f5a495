"""Splitting reads, files and contigs into chunks, and the tasks that chunks make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dna import chunk_id
from .asof import as_of


def read_chunk(read_no: Column, n_reads: Column | int, chunks: int) -> Column:
    """0-based chunk of a 1-based read number, chunks being of ceil(n_reads / chunks) reads."""
    n = F.lit(n_reads) if isinstance(n_reads, int) else n_reads
    return F.floor((read_no - 1) / F.greatest(F.ceil(n / chunks), F.lit(1))).cast("int")


def line_pairs(spark: SparkSession, n_lines: int, chunks: int) -> DataFrame:
    """chunk_id, line_0, line_1: 1-based half-open lines of FASTQ chunks; every pair ends within the file."""
    if n_lines % 4:
        raise ValueError("a FASTQ file has four lines for each read")
    batch = 4 * -(-(n_lines // 4) // chunks) or 4
    i = F.col("id")
    pairs = spark.range(chunks).select(i.cast("int").alias("chunk_id"), F.least(i * batch + 1, F.lit(n_lines + 1)).alias("line_0"), F.least((i + 1) * batch + 1, F.lit(n_lines + 1)).alias("line_1"))
    return pairs.where("line_0 < line_1")


def read_ranges(spark: SparkSession, n_reads: int, chunks: int) -> DataFrame:
    """chunk_id, read_0, read_1: 1-based inclusive read numbers, without overlap."""
    batch = max(1, -(-n_reads // chunks))
    i = F.col("id")
    return spark.range(chunks).select(i.cast("int").alias("chunk_id"), (i * batch + 1).alias("read_0"), F.least((i + 1) * batch, F.lit(n_reads)).alias("read_1")).where("read_0 <= read_1")


def fasta_chunks(faidx: DataFrame, file_size: int, chunks: int) -> DataFrame:
    """chunk_id, contig, offset_head, offset_base, last_byte, first: byte ranges of a FASTA file in `chunks` parts.

    faidx(contig, offset_head, offset_base). Cuts fall at multiples of ceil(file_size / chunks); one that falls in a
    header moves to the header's start. offset_base is where a chunk's bases begin, last_byte its last byte, and first
    the number of bytes of the contig's sequence before it, so that positions can be told in contig coordinates.
    """
    spark = faidx.sparkSession
    step = max(1, -(-file_size // chunks))
    cuts = spark.range(chunks).select((F.col("id") * step).alias("cut")).where(F.col("cut") < file_size)
    # each cut finds the last contig that begins at or before it, without a join over an inequality
    heads = faidx.select(F.col("offset_head").cast("long").alias("cut"), "contig", "offset_head", "offset_base")
    hit = as_of(cuts, heads, "cut", (), ("contig", "offset_head", "offset_base")).select("cut", F.struct(*(F.col(f"{c}_asof").alias(c) for c in ("contig", "offset_head", "offset_base"))).alias("c"))
    placed = hit.select(F.when(F.col("cut") < F.col("c.offset_base"), F.col("c.offset_head")).otherwise(F.col("cut")).alias("begin"), "c").dropDuplicates(["begin"])
    w = Window.orderBy("begin")  # one row for each chunk
    return placed.select(
        (F.row_number().over(w) - 1).alias("chunk_id"),
        F.col("c.contig").alias("contig"),
        F.col("c.offset_head").alias("offset_head"),
        F.greatest("begin", "c.offset_base").alias("offset_base"),
        (F.lead("begin", 1, file_size).over(w) - 1).alias("last_byte"),
        F.greatest(F.col("begin") - F.col("c.offset_base"), F.lit(0).cast("long")).alias("first"),
    )


def chunk_slice(chunks: DataFrame, begin: int | None, end: int | None, column: str = "chunk_id") -> DataFrame:
    """Chunks begin <= id < end; None leaves an end open."""
    if begin is not None:
        chunks = chunks.where(F.col(column) >= begin)
    return chunks if end is None else chunks.where(F.col(column) < end)


def task_grid(fasta: DataFrame, fastq: DataFrame) -> DataFrame:
    """fasta_chunk, fastq_chunk, task: all pairs of the chunks of two short lists."""
    pairs = fastq.select(F.col("chunk_id").alias("fastq_chunk")).crossJoin(F.broadcast(fasta.select(F.col("chunk_id").alias("fasta_chunk"))))
    return pairs.select("fasta_chunk", "fastq_chunk", task_name(F.col("fasta_chunk"), F.col("fastq_chunk")).alias("task"))


def task_name(fasta_chunk: Column, fastq_chunk: Column) -> Column:
    return F.concat(chunk_id("fa", fasta_chunk), F.lit("-"), chunk_id("fq", fastq_chunk))


def parse_task(task: Column) -> tuple[Column, Column]:
    """(fasta_chunk, fastq_chunk) of a task's name."""
    return tuple(F.regexp_extract(task, f"{p}([0-9]+)", 1).cast("int").alias(f"{n}_chunk") for p, n in (("fa", "fasta"), ("fq", "fastq")))


def keys_by_part(keys: DataFrame, pattern: str, column: str = "key") -> DataFrame:
    """part, keys: object keys grouped by what `pattern` finds in them, in order and joined by commas."""
    return keys.groupBy(F.regexp_extract(column, pattern, 1).alias("part")).agg(F.array_join(F.sort_array(F.collect_list(column)), ",").alias("keys"))


def missing_chunks(wanted: DataFrame, cached: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks that no cached object exists for."""
    return wanted.join(cached.select(key).distinct(), key, "left_anti")
