"""Base counts that grow as observations arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import base_counts


def stream_counts(observations: DataFrame) -> DataFrame:
    """base_counts() of a streaming frame: a fixed-size state for each position, brought up to date by each batch."""
    return base_counts(observations)


def start_counts(observations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's changed positions to a folder `path/batch=N`; a batch that is run again replaces its folder."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream_counts(observations).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()
