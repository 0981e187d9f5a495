"""Best-fit packing of documents into bins under conflicts of source and duplicate cluster."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, text_batches

#: Words that a bin holds, documents of one source that a bin may hold, and documents that are packed together.
CAPACITY, SOURCE_QUOTA, SHARD_ROWS = 2048, 4, 8192
#: Rows that repeat entirely (id, source, length and text) that go to one shard together; the next ones go to another.
COPIES = 256


def cluster_of(text: Column) -> Column:
    """Texts that differ only in case and white space are duplicates."""
    return F.xxhash64(F.lower(F.regexp_replace(F.trim(text), r"\s+", " ")))


def pack(items: list[tuple[int, object, object]], capacity: int = CAPACITY, quota: int = SOURCE_QUOTA) -> list[int]:
    """The bin of each item (length, source, cluster), lengths from 0 to capacity.

    Longest first. Open bins stand in order of their residual space, each with a bitmap: `quota` bits for a source, one for
    a cluster that has several items. The search starts at the least residual that holds the item and goes on to the
    next bin until one is compatible; so the bin taken is the tightest compatible one, and a new one is opened only if
    there is none. A null source or cluster conflicts with nothing.
    """
    often = Counter(c for _, _, c in items if c is not None)
    bit: dict[object, int] = {}

    def number(key: object, width: int) -> int:
        if key not in bit:
            bit[key] = number.free
            number.free += width
        return bit[key]

    number.free = 0
    order: list[tuple[int, int]] = []
    masks: list[int] = []
    out = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        length, source, cluster = items[i]
        own = 1 << number(("c", cluster), 1) if cluster is not None and often[cluster] > 1 else 0
        first = number(("s", source), quota) if source is not None else -1
        full = own | (1 << (first + quota - 1) if first >= 0 else 0)  # a source's bits fill from below
        at = bisect_left(order, (length, -1))
        while at < len(order) and masks[order[at][1]] & full:
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(masks)
            masks.append(0)
        if first >= 0:
            held = masks[b] >> first & ((1 << quota) - 1)
            masks[b] |= (held + 1) << first
        masks[b] |= own
        out[i] = b
        insort(order, (left - length, b))
    return out


def best_fit(docs: DataFrame, capacity: int = CAPACITY, quota: int = SOURCE_QUOTA, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """bin_id, doc_id, part, begin, n_words: where each part of each document goes.

    Lengths count words (runs of characters that are not white space). A document of more words than a bin holds is cut;
    its full parts are bins by themselves, the rest is packed. No bin has two documents of one duplicate cluster (or
    parts of one document), nor more than quota of one source. Rows are dealt by a hash of their values into shards of
    about SHARD_ROWS documents, each packed by itself; only ids, lengths and hashes are shuffled, never texts. Conflicts
    hold within bins, so shards cannot break them.
    Null and empty texts have no words: they go nowhere, one row with a null bin. A null id stays null, a null source
    conflicts with nothing; repeated rows are duplicates of each other and so go to different bins. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.cast("long").alias("n"), cluster_of(text).alias("cluster"))
    shards = max(1, math.ceil(docs.count() / SHARD_ROWS))
    parts = min(shards, 4 * partitions(spark))  # a task packs one shard after the other
    # rows that repeat entirely would all fall to one shard: their number among equals sends them on, SHARD_ROWS to each
    equal = rows.groupBy("doc_id", "source", "n", "cluster").agg(F.count(F.lit(1)).alias("times"))
    copies = equal.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / COPIES).cast("int"))))
    rows = copies.withColumn("here", F.least(F.lit(COPIES), F.col("times") - F.col("part") * COPIES)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("here").cast("int"))))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "n", "part"), F.lit(shards)).cast("int"))
    schema = "bin_id string, doc_id long, part int, begin long, n_words long"

    def shard_rows(key: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids, sources, lengths, clusters = (t.column(k).to_pylist() for k in ("doc_id", "source", "n", "cluster"))
        # equal rows may arrive in any order; sorted, a shard is packed alike each time
        rank = sorted(range(len(ids)), key=lambda i: (-(lengths[i] % capacity), ids[i] is None, ids[i] or 0, clusters[i], sources[i] or ""))
        full, rest = [], []
        for i in rank:
            parts, left = divmod(lengths[i], capacity)
            full += [(f"{key}-{ids[i]}-{i}-{p}", ids[i], p, p * capacity, capacity) for p in range(parts)]
            if left:
                rest.append((left, i, parts))
            elif not parts:
                full.append((None, ids[i], 0, 0, 0))
        bins = pack([(left, sources[i], clusters[i]) for left, i, _ in rest], capacity, quota)
        full += [(f"{key}-{b}", ids[i], p, p * capacity, left) for b, (left, i, p) in zip(bins, rest, strict=True)]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        columns = list(zip(*full, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bin_id", "doc_id", "part", "begin", "n_words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            begin = 0
            while begin < len(keys):
                end = begin + int((keys[begin:] == keys[begin]).sum())  # sorted, so equal keys stand together
                if held and keys[begin] != now:
                    yield shard_rows(now, held)
                    held = []
                now = int(keys[begin])
                held.append(batch.slice(begin, end - begin))
                begin = end
        if held:
            yield shard_rows(now, held)

    text_batches(spark)
    return dealt.select("shard", "doc_id", "source", "n", "cluster").repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard").mapInArrow(run, schema)
