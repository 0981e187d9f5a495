"""What the operators of this folder share: reading tables, shared scratch tables, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes at which an Arrow batch ends. Every operator sets the same, for the session's value at run time counts.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20


#: Whether a finished write's shuffle files go at once; else they stay until the driver's JVM happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Edges up to which a round of components() broadcasts nodes with their least neighbour (two longs, 8 MB).
BROADCAST_EDGES = 500_000

#: Rows of a few longs (2 to 4 MB) that one task writes, where a table's rows are bounded beforehand.
FILE_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch can hold in a Python worker: rows up to BATCH_BYTES, and the one that goes beyond."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; made only where the session names none and is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        root = tempfile.mkdtemp(prefix="pilespark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables in the shared folder that cut lineage, so a lost executor costs a reread and no recomputation.

    drop() removes a table once nothing reads it any more, only() all but those named; what a returned frame still reads
    stays until the caller clears the shared folder. A table's shuffle files go when it is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/pilespark-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: set[str] = set()

    def keep(self, df: DataFrame, most: int | None = None) -> DataFrame:
        """Write df and read it back; `most` tells that it has no more rows than that, of a few longs and little work each.

        Then no more files are written than these rows fill, whether or not adaptive execution puts partitions together. A
        file costs a request in a store, and on a local disk without Hadoop's native code child processes that set its
        permissions, each of which looks as large as its executor until it has begun.
        """
        if most is not None:
            df = df.coalesce(max(1, -(-most // FILE_ROWS)))
        self.n += 1
        path = f"{self.base}/{self.n}"
        # zstd, for the default codec leaves buffers outside the heap with each small file that is read
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths.add(path)
        kept._scratch_path = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                self._remove(path)

    def only(self, *frames: DataFrame) -> None:
        """Remove all tables kept here but these."""
        for path in self.paths - {f._scratch_path for f in frames}:
            self._remove(path)

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.paths.discard(path)


def small(df: DataFrame, rows: int, array: str | None = None) -> DataFrame:
    """df, marked for broadcast if it has no more than `rows` rows, entries of `array` counted too; it must be cheap to count."""
    if array is None:
        n = df.count()
    else:
        n = df.agg(F.sum(F.size(array).cast("long") + 1)).first()[0] or 0
    return F.broadcast(df) if n <= rows else df


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, most: int | None = None) -> DataFrame:
    """(node, root): each node of the undirected edges (a, b) with the smallest node of its component.

    Alternates the large-star and small-star steps of distributed union-find until no edge changes. Edges are kept with
    the greater node first; minima are aggregated before the shuffle, written, and joined back as a table, so that both
    sides of the join come straight from a shuffle and adaptive execution can split what a node with many neighbours
    brings. Loops and repeated edges do no harm; a node that only has a loop is its own root. `most` bounds the edges' number
    if that is known; a round never makes more of them.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), most)
    before = None
    n_edges = now.count()
    while True:
        # few edges: what is joined back is broadcast, and a round is one table
        few = n_edges <= BROADCAST_EDGES
        made: list[DataFrame] = []

        def held(df: DataFrame, made=made, few=few) -> DataFrame:
            if few:
                return df
            made.append(scratch.keep(df))
            return made[-1]

        back = F.broadcast if few else (lambda df: df)
        # large-star: every neighbour above a node moves to the least node around it, which is the node itself if it
        # has no neighbour below
        least = held(now.groupBy("u").agg(F.min("v").alias("m")))
        large = held(now.join(back(least.withColumnRenamed("u", "v")), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        # small-star: every neighbour below a node, and the node, move to the least of them
        low = held(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(back(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), n_edges)
        state = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(now, *made)
        now, n_edges = after, state[0]
        if state == before:
            break
        before = state
    # in the end each edge leads from a node to its root
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
