"""MAP records of an aligner: tab-separated text, single-end (5 fields) or paired-end (7 fields)."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SINGLE = ("name", "seq", "qual", "summary", "alignments")
PAIRED = ("name", "seq", "seq2", "qual", "qual2", "summary", "alignments")


def parse_map(lines: DataFrame, paired: bool = False, line: str = "value") -> DataFrame:
    """Fields of MAP lines, with the lines' other columns; shorter lines are left out."""
    names = PAIRED if paired else SINGLE
    fields: Column = F.split(line, "\t")
    rows = lines.withColumn("_f", fields).where(F.size("_f") >= len(names))
    return rows.select(*(c for c in lines.columns if c != line), *(F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names)))


def read_map(spark: SparkSession, path: str, paired: bool = False) -> DataFrame:
    return parse_map(spark.read.text(path), paired)


def write_map(records: DataFrame, path: str, paired: bool = False) -> None:
    """Records as text; columns beyond the fields are left out."""
    records.select(F.concat_ws("\t", *(PAIRED if paired else SINGLE)).alias("value")).write.mode("overwrite").text(path)


def read_zipped(spark: SparkSession, path: str) -> DataFrame:
    """path, value: lines of the members of ZIP containers, a container a row of work."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        yield pd.DataFrame({"path": p, "value": z.read(name).decode().splitlines()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, value string")
