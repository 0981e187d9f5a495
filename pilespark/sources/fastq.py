"""FASTQ files, plain or gzip, by record number."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import numbered_lines


def read_fastq(spark: SparkSession, path: str, read_0: int = 1, read_1: int | None = None) -> DataFrame:
    """file, read_no (1-based in its file), name, seq, qual of the records read_0 to read_1 (inclusive) of each file.

    path may be a pattern or a folder, on any store that Spark reads. A plain file is read in blocks by many tasks, a gzip
    file by one; the four lines of a record meet in a shuffle by file and record, so they may lie in two blocks. Blank lines
    after the last record are passed over; anything else that is not FASTQ is an error.
    """
    place, record = (F.col("line_no") - 1) % 4, F.floor((F.col("line_no") - 1) / 4) + 1
    lines = numbered_lines(spark, path).select("file", record.alias("read_no"), place.alias("place"), F.regexp_replace("line", r"\r$", "").alias("line"))
    lines = lines.where(F.col("read_no") >= read_0)
    if read_1 is not None:
        lines = lines.where(F.col("read_no") <= read_1)
    parts = [F.coalesce(F.max(F.when(F.col("place") == k, F.col("line"))), F.lit("")).alias(c) for k, c in enumerate(("head", "seq", "plus", "qual"))]
    records = lines.groupBy("file", "read_no").agg(*parts).where("concat(head, seq, plus, qual) <> ''")
    fits = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual"))
    wrong = F.raise_error(F.concat("file", F.lit(": record "), F.col("read_no").cast("string"), F.lit(" is not FASTQ"))).cast("boolean")
    return records.where(F.when(fits, F.lit(True)).otherwise(wrong)).select("file", "read_no", F.regexp_extract("head", r"^@\s*(\S*)", 1).alias("name"), "seq", "qual")


def write_fastq(reads: DataFrame, path: str, compression: str = "gzip") -> None:
    """reads(name, seq, qual) as text, one file a partition."""
    reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual").alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def gzip_windows(path: str, span: int = 1 << 20, block: int = 65_536) -> list[tuple[int, int, int, int]]:
    """(window, compressed_byte, uncompressed_byte, line_number): where decompression stands about every `span` bytes.

    Lines count from 1; a window's line is the first that begins at or after its byte.
    """
    out = [(0, 0, 0, 1)]
    d = zlib.decompressobj(31)
    taken = made = lines = 0
    with open(path, "rb") as f:
        while data := f.read(block):
            taken += len(data)
            while data:
                text = d.decompress(data)
                made += len(text)
                lines += text.count(b"\n")
                data = d.unused_data
                if d.eof:
                    if not data:
                        break
                    d = zlib.decompressobj(31)
                else:
                    data = b""
            if made - out[-1][2] >= span:
                out.append((len(out), taken, made, lines + 1))
    return out


def window_table(spark: SparkSession, path: str, span: int = 1 << 20) -> DataFrame:
    """window, compressed_byte, uncompressed_byte, line_number of a gzip file, made on one executor."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for p in batch["path"]:
                yield pd.DataFrame(gzip_windows(p, span), columns=["window", "compressed_byte", "uncompressed_byte", "line_number"])

    return spark.createDataFrame([(path,)], "path string").mapInPandas(run, "window long, compressed_byte long, uncompressed_byte long, line_number long")


def parse_listing(listing: DataFrame) -> DataFrame:
    """Window rows of an index tool's text listing: lines(value) with the numbers of each window, in order."""
    found = F.transform(F.regexp_extract_all("value", F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))
    names = ("window", "compressed_byte", "uncompressed_byte", "line_number", "window_size", "window_offset")
    return listing.select(found.alias("n")).where(F.size("n") >= 6).select(*(F.get("n", F.lit(i)).alias(c) for i, c in enumerate(names)))


def run_spots(spark: SparkSession, xml: str) -> DataFrame:
    """total_spots of the first run in an archive's metadata XML."""
    return spark.createDataFrame([(xml,)], "xml string").select(F.expr("xpath_long(xml, '//RUN[1]/@total_spots')").alias("total_spots"))
