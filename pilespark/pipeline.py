"""From FASTA and FASTQ to called variants, a stage a method."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dna import is_accession
from .operators import kmer, merge, partition, pileup, ranges, stratum
from .sources import fasta, fastq, storage
from .stats import Stats

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Params:
    """What a run works on and how. Paths may be any that Spark reads, but FASTQ and FASTA index paths, which are files."""

    fasta_path: str
    fastq_path: str
    output_path: str
    fasta_chunks: int = 1
    fastq_chunks: int = 1
    tolerance: int = 0
    seed: int = 16
    most_mismatches: int = 3
    least_depth: int = 4
    least_count: int = 2
    least_ppm: int = 200_000
    range_capacity: int = ranges.CAPACITY
    fasta_range: tuple[int, int] | None = None
    fastq_range: tuple[int, int] | None = None
    accession: str | None = None
    skip_prep: bool = False
    skip_map: bool = False
    skip_reduce: bool = False
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def check(self, spark: SparkSession) -> Params:
        for name in ("fasta_path", "fastq_path", "output_path"):
            if not getattr(self, name):
                raise ValueError(f"{name} is missing")
        if min(self.fasta_chunks, self.fastq_chunks) < 1 or self.tolerance < 0:
            raise ValueError("chunks must be 1 or more and tolerance 0 or more")
        if self.accession and not spark.range(1).select(is_accession(F.lit(self.accession))).first()[0]:
            raise ValueError(f"{self.accession} is not a run accession")
        return self


class Pipeline:
    """preprocess(), alignment(), reduce(), or run() for all; each stage's table is kept under output_path/run_id.

    A stage whose table exists is read and not made again, so a run that was cut short goes on where it stopped.
    """

    def __init__(self, spark: SparkSession, params: Params | None = None, **values):
        self.spark = spark
        self.params = (replace(params, **values) if params else Params(**values)).check(spark)
        self.timers = Stats()

    def path(self, stage: str) -> str:
        return f"{self.params.output_path}/{self.params.run_id}/{stage}"

    def exists(self, path: str) -> bool:
        return storage.exists(self.spark, path)

    def kept(self, stage: str, make) -> DataFrame:
        if not self.exists(f"{self.path(stage)}/_SUCCESS"):
            with self.timers.timed(stage):
                make().write.mode("overwrite").parquet(self.path(stage))
        else:
            log.info("stage %s is there", stage)
        return self.spark.read.parquet(self.path(stage))

    def preprocess(self) -> tuple[DataFrame, DataFrame]:
        """(contigs with their chunk, reads with their chunk)."""
        p = self.params
        if p.skip_prep:
            return self.spark.read.parquet(self.path("contigs")), self.spark.read.parquet(self.path("reads"))
        contigs = self.kept("contigs", lambda: fasta.read_contigs(self.spark, p.fasta_path).withColumn("chunk_id", F.pmod(F.xxhash64("contig"), F.lit(p.fasta_chunks)).cast("int")))
        reads = self.kept("reads", lambda: self.numbered(fastq.read_fastq(self.spark, p.fastq_path)))
        return partition.chunk_slice(contigs, *(p.fasta_range or (None, None))), partition.chunk_slice(reads, *(p.fastq_range or (None, None)))

    def numbered(self, reads: DataFrame) -> DataFrame:
        """Reads with read_id, unique over files, and the chunk of their number."""
        p = self.params
        chunks = F.pmod(F.floor((F.col("read_no") - 1) / 4096), F.lit(p.fastq_chunks)).cast("int")
        return reads.select(F.xxhash64("file", "read_no").alias("read_id"), "name", "seq", "qual", chunks.alias("chunk_id")).repartition("read_id")

    def alignment(self) -> DataFrame:
        """Base observations of all reads' alignments that hold against the best over all reference chunks."""
        p = self.params
        if p.skip_map:
            return self.spark.read.parquet(self.path("observations"))
        contigs, reads = self.preprocess()

        def mapped() -> DataFrame:
            records = kmer.align(reads.drop("chunk_id"), contigs, p.seed, p.most_mismatches, by=("chunk_id",))
            return records.withColumnRenamed("chunk_id", "fasta_chunk")

        records = self.kept("map", mapped)
        index = stratum.index_reads(records)
        best = stratum.best_per_read(index)
        corrected = stratum.correct(index, best, p.tolerance)
        return self.kept("observations", lambda: pileup.pileup(corrected, contigs))

    def reduce(self) -> DataFrame:
        """Called variants; the merged pileup is kept beside them."""
        p = self.params
        if p.skip_reduce:
            return self.spark.read.parquet(self.path("variants"))
        rows = self.alignment()
        self.kept("pileup", lambda: merge.merge_pileups(rows))
        return self.kept("variants", lambda: merge.call_variants(merge.base_counts(rows), p.least_depth, p.least_count, p.least_ppm))

    def tasks(self) -> DataFrame:
        """Position ranges of about range_capacity observations by contig."""
        return ranges.reducer_tasks(ranges.cumulative_ranges(ranges.position_histogram(self.alignment(), "chrom"), self.params.range_capacity))

    def run(self) -> DataFrame:
        out = self.reduce()
        self.timers.store(self.spark, self.path("stats"))
        return out

    def stats(self) -> DataFrame:
        return self.timers.frame(self.spark)

    def clean(self, *stages: str) -> None:
        """Remove the named stages' tables, or all of the run."""
        storage.remove(self.spark, *([self.path(s) for s in stages] or [f"{self.params.output_path}/{self.params.run_id}"]))

    def clean_temporary(self) -> None:
        """Remove what only serves a later run of the same id; variants and pileup stay."""
        self.clean("contigs", "reads", "map", "observations")
