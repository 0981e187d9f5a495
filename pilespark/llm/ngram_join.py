"""Self-join of documents on the Jaccard similarity of word shingles, by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, partitions, text_batches
from .shingles import batch_words, mix, shingle_set

#: Recall that runs are repeated for, and levels of a run. A pair at the threshold shares a chosen token with probability
#: 1 - 1/e at each level, so a run that goes down all levels finds it with at least ONE_RUN.
RECALL, LEVELS = 0.995, 3
ONE_RUN = (1 - math.exp(-1)) ** 2
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - ONE_RUN))
#: Largest bucket compared pair by pair; members of a block in the exact count of links; minima in a sketch.
SMALL, BLOCK, SKETCH = 64, 2048, 128
#: Shingles up to which a set is compared by all its tokens, as a sketch of few shingles has too large an error.
WHOLE = 256
#: How far below the threshold the estimate of larger sets may fall before a pair is given up: above 4 standard errors,
#: for sets of over WHOLE shingles fill more than 110 of the SKETCH bins.
SLACK = 0.2
#: Members of a block where what is left at the last level is compared in pairs of blocks.
LAST = 256
#: Counts are whole numbers; this keeps a pair exactly at the threshold from rounding away.
EXACT = 1e-6
#: Ids that may be broadcast: 2 million longs.
BROADCAST_IDS = 2_000_000
SKETCH_SEEDS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(tokens: np.ndarray) -> bytes:
    """One byte of the minimum under each of SKETCH hash functions, by one permutation with rotation."""
    h = mix(tokens ^ np.uint64(0xA0761D6478BD642F))
    bins = (h >> np.uint64(57)).astype(np.int64)
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bins, h)
    full = np.flatnonzero(least != np.iinfo(np.uint64).max)
    least = least[full[np.searchsorted(full, np.arange(SKETCH)) % len(full)]]
    return (mix(least ^ SKETCH_SEEDS) & np.uint64(255)).astype(np.uint8).tobytes()


def chosen(tokens: np.ndarray, threshold: float) -> list[list[list[int]]]:
    """By run and level, the tokens on which a set goes on: each with probability 1 / (threshold * size).

    Two sets at the threshold share one chosen token on average at each level, whatever else they hold.
    """
    most = np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(tokens)))))
    out = []
    for run in range(RUNS):
        levels = []
        for level in range(LEVELS):
            seed = mix(np.array([run * LEVELS + level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
            r = mix(tokens ^ seed)
            levels.append((tokens[r < most] ^ seed).view(np.int64).tolist())
        out.append(levels)
    return out


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from sketches (rows of a against rows of b, broadcast)."""
    same = (a == b).mean(axis=-1)
    return (same - 1 / 256) * 256 / 255


def common_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of how many tokens each two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for b in range(0, width, 1024):
        lo, hi = np.searchsorted(column, [b, b + 1024])
        x = np.zeros((len(sets), min(1024, width - b)), np.float32)
        x[owner[lo:hi], column[lo:hi] - b] = 1
        out += x @ x.T
    return out


def halves(tokens: np.ndarray) -> np.ndarray:
    """The distinct lower halves of hashes: half the bytes, and enough to propose pairs by.

    A set of n hashes with m halves has lost n - m of them. Of two sets' common hashes no more than the smaller of both
    losses is missing among their common halves, so with that added no pair is counted too low.
    """
    return np.unique(tokens.astype(np.uint32))


def proposed(size: np.ndarray, sketches: np.ndarray, whole: list[bytes], threshold: float) -> np.ndarray:
    """Which texts of a bucket may be alike: by their sketches, and sets of up to WHOLE shingles by their halves."""
    close = np.minimum(size[:, None], size) >= threshold * np.maximum(size[:, None], size) - EXACT
    few = size <= WHOLE
    linked = np.empty(close.shape, bool)
    for b in range(0, len(size), 64):
        linked[b : b + 64] = alike(sketches[b : b + 64, None, :], sketches[None, :, :]) >= threshold - SLACK
    linked &= close
    open_ = close & ~linked & few[:, None] & few
    if open_.any():
        at = np.flatnonzero(open_.any(axis=0))
        sets, n = [np.frombuffer(whole[i], np.uint32) for i in at], size[at]
        lost = n - np.array([len(x) for x in sets])
        common = common_tokens(sets) + np.minimum(lost[:, None], lost)
        linked[np.ix_(at, at)] |= (common >= threshold * (n[:, None] + n - common) - EXACT) & open_[np.ix_(at, at)]
    return linked


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the first row of its component."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            root[i] = i
            front = np.array([i])
            while len(front):
                reached = linked[front].any(axis=0) & (root < 0)
                root[reached] = i
                front = np.flatnonzero(reached)
    return root


def scan(docs: DataFrame, threshold: float, n: int, with_paths: bool) -> DataFrame:
    """docs(id, text) -> the key, size, sketch and chosen tokens of each text that has words; or else its token set."""
    if with_paths:
        schema = "id long, key binary, size int, sketch binary, whole binary, paths array<array<array<bigint>>>"
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.list_(pa.int64())))]
    else:
        schema, kinds = "id long, tokens array<bigint>", [pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, w in zip(batch.column(0).to_pylist(), batch_words(batch.column(1)), strict=True):
                tokens = shingle_set(w, n)
                if not len(tokens):
                    continue
                if with_paths:
                    key = np.array([len(tokens), np.add.reduce(tokens), np.add.reduce(mix(tokens)), np.bitwise_xor.reduce(mix(tokens + np.uint64(7)))], np.uint64).tobytes()
                    rows.append((i, key, len(tokens), sketch(tokens), halves(tokens).tobytes() if len(tokens) <= WHOLE else b"", chosen(tokens, threshold)))
                else:
                    rows.append((i, tokens.view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[c.split(" ")[0] for c in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows of equal first column as tables; what is held is one group and one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for b, e in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(b, e - b)
            if held and held[0].column(0)[0] != part.column(0)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def candidate_edges(reps: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b): edges that connect all pairs of texts which some bucket shows to be alike by sketches or tokens."""
    spark = reps.sparkSession
    found: list[DataFrame] = []
    rows = reps.select("id", F.posexplode("paths").alias("run", "levels")).select("id", "run", F.explode(F.element_at("levels", 1)).alias("path"))
    rows = rows.select("id", "run", F.xxhash64("run", "path").alias("path"))
    facts = reps.select("id", "size", "sketch", "whole")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a: list[int] = []
        out_b: list[int] = []
        for t in groups(batches):
            ids, size = t.column("id").to_numpy(), t.column("size").to_numpy().astype(float)
            s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
            root = forest(proposed(size, s, t.column("whole").to_pylist(), threshold))
            at = np.flatnonzero(root != np.arange(len(root)))
            out_a += ids[at].tolist()
            out_b += ids[root[at]].tolist()
            if len(out_a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
                out_a, out_b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    def close_to_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            s, lead = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(n, -1) for k in ("sketch", "lead_sketch"))
            far = batch.column("far").to_numpy(zero_copy_only=False).astype(bool)
            near = (alike(s, lead) >= threshold - SLACK) & ~far if n else np.empty(0, bool)
            size, lead_size = (batch.column(k).to_numpy() for k in ("size", "lead_size"))
            for i in np.flatnonzero(~near & ~far & (size <= WHOLE) & (lead_size <= WHOLE)).tolist():
                x, y = (np.frombuffer(batch.column(k)[i].as_py(), np.uint32) for k in ("whole", "lead_whole"))
                n, m = int(size[i]), int(lead_size[i])
                common = len(np.intersect1d(x, y, assume_unique=True)) + min(n - len(x), m - len(y))
                near[i] = common >= threshold * (n + m - common) - EXACT
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("path", "run", "id", "lead")), pa.array(near, pa.bool_())], names=["path", "run", "id", "lead", "near"])

    def compared(buckets: DataFrame) -> DataFrame:
        """Edges of buckets(path, id), each compared in one task."""
        each = buckets.join(facts, "id").select("path", "id", "size", "sketch", "whole")
        return each.repartition(partitions(spark), "path").sortWithinPartitions("path").mapInArrow(pairs, "a long, b long").distinct()

    for level in range(1, LEVELS + 1):
        rows = scratch.keep(rows)
        counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("id", "path").alias("h"), "id")).alias("first")).where("n > 1")
        sized = rows.join(counts, "path")
        found.append(scratch.keep(compared(sized.where(F.col("n") <= SMALL).select("path", "id"))))
        leaders = counts.where(F.col("n") > SMALL).select("path", F.col("first.id").alias("lead")).join(facts.select(F.col("id").alias("lead"), F.col("size").alias("lead_size"), F.col("sketch").alias("lead_sketch"), F.col("whole").alias("lead_whole")), "lead")
        big = rows.join(leaders, "path").where("id <> lead").join(facts, "id")
        far = (F.least("size", "lead_size") < threshold * F.greatest("size", "lead_size") - EXACT).alias("far")
        big = scratch.keep(big.select("path", "run", "id", "lead", "size", "lead_size", "sketch", "lead_sketch", "whole", "lead_whole", far).mapInArrow(close_to_leader, "path long, run int, id long, lead long, near boolean"))
        found.append(big.where("near").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct())
        scratch.drop(rows)
        if big.where("not near").isEmpty():
            break
        if level == LEVELS:
            # all that is left is compared, in pairs of blocks where a bucket is large
            rest = big.where("not near").select("path", "id").distinct()
            dealt = rest.join(rest.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / LAST).cast("int").alias("nb")), "path").withColumn("mine", F.pmod(F.xxhash64("id", F.lit(1)), F.col("nb")).cast("int"))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            found.append(scratch.keep(compared(dealt.select(F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other")).alias("path"), "id"))))
            break
        # what is unlike the leader splits on the tokens of the next level
        deeper = reps.select("id", "paths")
        rows = big.where("not near").select("path", "run", "id").join(deeper, "id").select("id", "run", "path", F.explode(F.element_at(F.element_at("paths", F.col("run") + 1), level + 1)).alias("token"))
        rows = rows.select("id", "run", F.xxhash64("path", "token").alias("path"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def exact_links(members: DataFrame, threshold: float) -> DataFrame:
    """members(comp, size, id, weight, tokens) -> (id, root, links), by comparing all members of a component.

    Components over BLOCK members are dealt out in pairs of blocks, each compared by itself, so a task holds two blocks
    at most. What leaves a task is one row for each member: the weights linked to it, and a member it is connected to.
    """
    spark = members.sparkSession
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.withColumn("nb", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select(F.xxhash64("comp", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "id", "weight", "mine", "other", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], [], []]
        held = 0
        for t in groups(batches):
            ids, weight, mine = (t.column(k).to_numpy() for k in ("id", "weight", "mine"))
            tokens = t.column("tokens").combine_chunks()
            lengths = np.diff(tokens.offsets.to_numpy())
            flat = tokens.flatten().to_numpy()
            common = common_tokens(np.split(flat, np.cumsum(lengths)[:-1]))
            either = lengths[:, None] + lengths - common
            linked = common >= threshold * either - EXACT
            np.fill_diagonal(linked, False)
            if len(set(mine.tolist())) > 1:  # pairs within a block are counted where the block meets itself
                linked &= mine[:, None] != mine
            root = forest(linked)
            for k, x in enumerate((ids, ids[root], linked @ weight)):
                out[k].append(x.astype(np.int64))
            held += len(ids)
            if held >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["id", "root", "links"])
                out, held = [[], [], []], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["id", "root", "links"])

    return dealt.select("key", "id", "weight", "mine", "tokens").repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(run, "id long, root long, links long")


def ngram_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links: the components of all pairs of documents whose n-word shingle sets are alike.

    Words are separated by white space and compared in lower case; a text of fewer than n words has one shingle. n_links
    counts the other documents at or above the threshold, copies included; class_id is the least id that links lead to.
    Texts with equal sets are one text with a weight. Chosen paths (RUNS runs) propose edges by sketches; all members of
    each proposed component are then compared exactly, on 64-bit hashes of shingles. A link is missed only where no run
    brought two texts together and no chain of proposed pairs connects them, or where such a pair of over WHOLE shingles
    is estimated more than SLACK too low; RUNS follows from the target RECALL.
    Null, empty and blank texts have no links; rows with a null id are left out; rows that repeat an id are one document
    with all their links. Other columns are not read.
    """
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "ngrams")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    facts = scratch.keep(scan(texts, threshold, n, True))
    classes = facts.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("whole").alias("whole"), F.first("paths").alias("paths"))
    reps = scratch.keep(classes)
    n_texts = facts.count()
    names, weights = scratch.keep(facts.select("id", "key"), n_texts), scratch.keep(reps.select("key", "id", "weight"), n_texts)
    scratch.drop(facts)
    edges = candidate_edges(reps, threshold, scratch)
    comps = scratch.keep(components(spark, edges, scratch), n_texts)
    scratch.only(names, weights, comps)
    sizes = comps.groupBy(F.col("root").alias("comp")).agg(F.count(F.lit(1)).alias("size"))
    members = scratch.keep(comps.select(F.col("node").alias("id"), F.col("root").alias("comp")).join(sizes, "comp"))
    wanted = members.join(weights.groupBy("id").agg(F.sum("weight").alias("weight")), "id")
    count = members.count()
    picked = texts.join(F.broadcast(members.select("id")) if count <= BROADCAST_IDS else members.select("id"), "id", "left_semi")
    sets = scan(picked, threshold, n, False)
    first = sets.groupBy("id").agg(F.min("tokens").alias("tokens"))
    links = scratch.keep(exact_links(wanted.join(first, "id"), threshold))
    roots = components(spark, links.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    linked = scratch.keep(links.groupBy("id").agg(F.sum("links").alias("links")).join(roots.select(F.col("node").alias("id"), "root"), "id"), n_texts)
    scratch.only(names, weights, linked)
    named = weights.select("key", F.col("id").alias("rep"), "weight").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    found = names.join(named, "key").select("id", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    rest = texts.select("id").join(names.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.union(rest).groupBy(F.col("id").alias("doc_id")).agg(F.min("class_id").alias("class_id"), F.max("n_links").cast("long").alias("n_links"))
