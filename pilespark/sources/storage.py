"""Files of any store that Spark reaches: existence, listing, removal, and names."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, *paths: str) -> None:
    """Remove files or folders; what is not there is passed over."""
    for path in paths:
        fs, p = _file_system(spark, path)
        fs.delete(p, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name where the driver and all executors read and write: under spark.checkpoint.dir.

    Where the session names none, a temporary folder serves, but only if the session is one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        root = tempfile.mkdtemp(prefix="pilespark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/pilespark-{name}-{uuid.uuid4().hex[:12]}"


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modified of the files under a folder; only metadata is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def split_uri(uri: str) -> tuple[str, str, str]:
    """(scheme, bucket, key) of scheme://bucket/key; `.` and `..` in the key are resolved, never above the bucket."""
    parts = urlsplit(uri)
    if not parts.scheme or not parts.netloc:
        raise ValueError(f"{uri} is not a storage address")
    key: list[str] = []
    for name in parts.path.split("/"):
        if name == "..":
            key = key[:-1]
        elif name not in ("", "."):
            key.append(name)
    return parts.scheme, parts.netloc, "/".join(key)


def stage_prefix(run_id: str, *stages: str) -> str:
    """Where a run keeps a stage's temporary objects."""
    return "/".join((f"run-{run_id}.tmp", *stages))
