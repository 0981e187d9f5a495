"""Command line: python -m pilespark.cli --fasta-path ... --fastq-path ... --output-path ..."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession

from .pipeline import Params, Pipeline


def parser() -> argparse.ArgumentParser:
    """An option for each field of Params; ranges are given as begin:end."""
    out = argparse.ArgumentParser(description="Call variants of reads against a reference.")
    for f in dataclasses.fields(Params):
        flag, needed = f"--{f.name.replace('_', '-')}", f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING
        if f.type == "bool":
            out.add_argument(flag, action="store_true")
        elif "tuple" in f.type:
            out.add_argument(flag, type=lambda s: tuple(map(int, s.split(":"))))
        else:
            out.add_argument(flag, type=int if f.type == "int" else str, required=needed)
    return out


def main(args: list[str] | None = None) -> None:
    given = {k: v for k, v in vars(parser().parse_args(args)).items() if v not in (None, False)}
    spark = SparkSession.builder.appName("pilespark").getOrCreate()
    Pipeline(spark, **given).run().show()


if __name__ == "__main__":
    main()
