"""Programs that read lines and write lines, run over a frame's partitions."""

from __future__ import annotations

import subprocess

import pandas as pd
from pyspark.sql import DataFrame


def pipe(lines: DataFrame, command: list[str], column: str = "value") -> DataFrame:
    """value: the lines that `command` writes when each batch of lines is fed to it; a failing command fails the task."""

    def run(batches):
        for batch in batches:
            done = subprocess.run(command, input="".join(f"{x}\n" for x in batch[column]), capture_output=True, text=True, check=True)
            yield pd.DataFrame({"value": done.stdout.splitlines()})

    return lines.select(column).mapInPandas(run, "value string")
