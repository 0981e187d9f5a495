"""Benchmark passages in documents, found by spaced seeds."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Scratch, small, text_batches
from .shingles import mix

#: Masks over token positions: 1 counts, 0 may differ. Six positions each, so one substituted token in any nine leaves a
#: mask that misses it.
MASKS = ("11101011", "110110101", "1100101101", "10110100011")
#: An overlap is a stretch of one diagonal with at least LEAST equal tokens (or LEAST_SHARE of a shorter passage) of which
#: at least SHARE are equal; it is scored +1 for an equal token and MISMATCH for another.
LEAST, LEAST_SHARE, SHARE, MISMATCH = 13, 0.8, 0.8, -2.0
LONGEST = max(map(len, MASKS)) - 1
#: Tokens below which a passage is told by an exact copy of all its tokens only.
SHORTEST = 8
#: A token is a run of word characters, or one character of a script that puts no blanks between words.
SCRIPTS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
UNSPACED, PLAIN, MIXED = re.compile(f"[{SCRIPTS}]"), re.compile(r"\w+"), re.compile(rf"[{SCRIPTS}]|[^\W{SCRIPTS}]+")
#: Hashes of tokens that a task remembers.
MEMO = 200_000
#: Tokens of a document that are hashed at once; slices overlap by the longest mask.
SLICE = 1 << 16
#: Rows of two longs, and bytes of passages, that may be broadcast (16 MB); more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20
#: The filter of benchmark hashes that travels to the tasks: a power of two of bits, at least and at most (2 MB), and how many
#: bits a hash; it only saves rows.
FILTER_LEAST, FILTER_MOST, FILTER_SHARE = 16, 24, 64
FACTORS = mix(np.arange(1, max(m.count("1") for m in MASKS) + SHORTEST + 1, dtype=np.uint64)) | np.uint64(1)


class Memo(dict):
    """Hashes of tokens, computed when first asked for."""

    def __missing__(self, token: str) -> int:
        h = self[token] = xxh3_64_intdigest(token)
        return h


def token_hashes(text: str, memo: Memo | None = None) -> np.ndarray:
    """A hash of each token of a text in lower case."""
    memo = Memo() if memo is None else memo
    if len(memo) > MEMO:
        memo.clear()
    found = (MIXED if UNSPACED.search(text) else PLAIN).findall(text.lower())
    return np.array([memo[w] for w in found], np.uint64)


def scaled(tokens: np.ndarray) -> list[np.ndarray]:
    """The tokens times the factor of each place among a mask's counting tokens."""
    return [tokens * f for f in FACTORS]


def windows(scaled_tokens: list[np.ndarray], mask: str) -> np.ndarray:
    """Hash of each window's counting tokens; none if there are fewer tokens. Its upper bits are the best mixed."""
    n = len(scaled_tokens[0]) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(len(mask)) * FACTORS[0])
    for k, j in enumerate(j for j, c in enumerate(mask) if c == "1"):
        h += scaled_tokens[k][j : j + n]
    return h


def masks_of(n: int) -> tuple[str, ...]:
    """The masks by which a passage of n tokens is looked for: the spaced ones, or all of it if it is short."""
    return MASKS if n >= SHORTEST else ("1" * n,)


def least(n: int) -> int:
    """Equal tokens that an overlap with a passage of n tokens has at least."""
    return n if n < SHORTEST else min(LEAST, math.ceil(LEAST_SHARE * n))


def widest(equal: np.ndarray) -> tuple[int, int, int]:
    """(equal tokens, begin, end) of the stretch with most equal tokens among those of which SHARE are equal.

    For each end the earliest begin that leaves the share counts, found among the prefix minima.
    """
    gain = round(100 * (1 - SHARE))
    sums = np.concatenate([[0], np.cumsum(np.where(equal, gain, gain - 100))])
    begins = np.searchsorted(-np.minimum.accumulate(sums), -sums, "left")
    count = np.concatenate([[0], np.cumsum(equal)])
    end = int(np.argmax(count - count[begins]))
    at = np.flatnonzero(equal[begins[end] : end]) + int(begins[end])  # it begins and ends with an equal token
    return (len(at), int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0, 0)


def overlap(tokens: np.ndarray, passage: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(equal tokens, begin, end in the document) of the best-scored stretch on a diagonal; if that is no overlap, of the
    stretch at SHARE that has most equal tokens."""
    b, e = max(0, diagonal), min(len(tokens), diagonal + len(passage))
    equal = tokens[b:e] == passage[b - diagonal : e - diagonal]
    sums = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, MISMATCH))])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    begin = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    n = int(equal[begin:end].sum())
    if n < least(len(passage)) or n < SHARE * (end - begin):
        n, begin, end = widest(equal)
    return n, b + begin, b + end


def best_overlap(tokens: np.ndarray, offset: int, passage: np.ndarray, diagonals: list[int]) -> tuple[int, int, int] | None:
    """The overlap with most equal tokens on some diagonals, ties to the earliest; tokens begin at `offset` of the document."""
    best = None
    for d in sorted(set(diagonals)):
        n, b, e = overlap(tokens, passage, d - offset)
        if n >= least(len(passage)) and n >= SHARE * (e - b) and (best is None or n > best[0]):
            best = n, b + offset, e + offset
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, n_equal, n_item, begin, end: the benchmark passages that each whole document overlaps.

    Masked windows of passages and of documents are joined on their hashes. A filter of the benchmark's hashes, of fixed
    size at most, travels to the tasks that read the documents, so that only what may match is shuffled; each hit is then
    verified along its diagonal, the part of the document around it against the passage. A hash that many windows share is
    split by the join's adaptive execution. Tokens are lower-cased runs of word characters, or single characters of
    scripts without blanks; begin and end count a document's tokens. A row is a document row's best overlap with a
    passage (most equal tokens, ties: the earliest). Passages of under SHORTEST tokens are found by exact copies of all
    their tokens. Null and empty texts, and passages without tokens, overlap nothing; null ids are kept; rows of documents
    that repeat id and text give one row (with other texts, a row each); items likewise; an empty table on either side
    gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "decontamination")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col("text").alias("text")).where("text is not null").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("salt"), F.col(text_col).alias("text")).where("text is not null")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = token_hashes(text)
                name = int.from_bytes(text_name(text), "little", signed=True)
                for mask in masks_of(len(tokens)) if len(tokens) else ():
                    h = windows(scaled(tokens), mask)
                    n = len(h)
                    columns = [pa.array([item] * n, pa.int64()), pa.array([name] * n, pa.int64()), pa.array([len(tokens)] * n, pa.int32()), pa.array(h.view(np.int64)), pa.array(np.arange(n), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "passage", "n_item", "h", "place"])

    seeds = scratch.keep(items.mapInArrow(index, "item long, passage long, n_item int, h long, place long"))
    hashes = seeds.select("h").distinct()
    n_seeds, power = seeds.count(), FILTER_LEAST
    while power < FILTER_MOST and 1 << power < FILTER_SHARE * n_seeds:
        power += 1
    # one row for each eight bytes of the filter that have a bit, at most 1 << FILTER_MOST - 6 whatever the benchmark's size
    words = hashes.select(F.shiftrightunsigned("h", 64 - power).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("one"))
    filter_words = np.zeros((1 << power) // 64, np.uint64)
    for r in words.groupBy("word").agg(F.bit_or("one").alias("ones")).toLocalIterator():
        filter_words[r["word"]] = np.int64(r["ones"]).view(np.uint64)
    short = sorted(r[0] for r in seeds.where(F.col("n_item") < SHORTEST).select("n_item").distinct().collect())  # SHORTEST at most
    looked_for = [*(MASKS if n_seeds else ()), *("1" * n for n in short)]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(filter_words.view(np.uint8), bitorder="little").view(bool)
        memo = Memo()
        for batch in batches:
            owners, lengths, found_h, found_at = [], [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for i, text in enumerate(batch.column(2).to_pylist()):
                tokens = token_hashes(text, memo)
                n = 0
                for begin in range(0, len(tokens), SLICE):
                    part = scaled(tokens[begin : begin + SLICE + LONGEST])
                    for mask in looked_for:
                        h = windows(part, mask)[:SLICE]
                        hit = np.flatnonzero(known[h >> np.uint64(64 - power)])
                        found_h.append(h[hit])
                        found_at.append(hit + begin)
                        n += len(hit)
                owners.append(i)
                lengths.append(n)
            rows = pa.array(np.repeat(np.array(owners, np.int64), lengths))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(found_h).view(np.int64)), pa.array(np.concatenate(found_at))], names=["doc", "salt", "h", "at"])

    looked = scratch.keep(rows.mapInArrow(look, "doc long, salt long, h long, at long"))
    hits = looked.join(small(seeds, BROADCAST_ROWS), "h").groupBy("doc", "salt", "item", "passage", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.max("n_item").alias("n_item"))
    # the diagonals of one document and passage, and the part of the document that they touch
    asked = hits.groupBy("doc", "salt", "item", "passage").agg(F.collect_list("diagonal").alias("diagonals"), F.max("n_item").alias("n_item"))
    asked = scratch.keep(asked)
    wanted = asked.groupBy(F.col("doc").alias("d"), F.col("salt").alias("s")).agg(F.collect_list(F.struct("item", "passage", "n_item", "diagonals")).alias("asked"))
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("salt") == F.col("s"))
    once = rows.join(small(scratch.keep(wanted), BROADCAST_ROWS, "asked"), same).dropDuplicates(["doc", "salt"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tokens of a document around each run of near diagonals."""
        names = ["doc", "salt", "item", "passage", "diagonals", "offset", "tokens"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        for batch in batches:
            for doc, salt, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = token_hashes(text)
                out = []
                for x in wanted:
                    runs: list[list[int]] = []
                    for d in sorted(set(x["diagonals"])):
                        if runs and d - runs[-1][-1] <= x["n_item"] and d - runs[-1][0] < SLICE:
                            runs[-1].append(d)
                        else:
                            runs.append([d])
                    for run in runs:
                        b, e = max(0, run[0]), run[-1] + x["n_item"]
                        out.append((doc, salt, x["item"], x["passage"], run, b, tokens[b:e].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names = [int.from_bytes(text_name(t), "little", signed=True) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([token_hashes(t).tobytes() for t in texts], pa.binary())], names=["passage", "passage_tokens"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "salt", "item", "n_equal", "n_item", "begin", "end"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            out = []
            for doc, salt, item, diagonals, offset, tokens, passage in zip(*(batch.column(k).to_pylist() for k in ("doc", "salt", "item", "diagonals", "offset", "tokens", "passage_tokens")), strict=True):
                p = np.frombuffer(passage, np.uint64)
                if x := best_overlap(np.frombuffer(tokens, np.uint64), offset, p, diagonals):
                    out.append((doc, salt, item, x[0], len(p), x[1], x[2]))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    cut = scratch.keep(once.select("doc", "salt", "text", "asked").mapInArrow(parts, "doc long, salt long, item long, passage long, diagonals array<long>, offset long, tokens binary"))
    texts = scratch.keep(items.mapInArrow(passages, "passage long, passage_tokens binary").dropDuplicates(["passage"]))
    size = texts.agg(F.sum(F.octet_length("passage_tokens"))).first()[0] or 0
    met = cut.join(F.broadcast(texts) if size <= BROADCAST_BYTES else texts, "passage")
    verified = met.mapInArrow(verify, "doc long, salt long, item long, n_equal int, n_item int, begin long, end long")
    # most equal tokens, then the earliest; of items that repeat an id with other texts, the best
    best = verified.groupBy("doc", "salt", "item", "n_item").agg(F.min(F.struct((-F.col("n_equal")).alias("fewer"), "begin", "end")).alias("x"))
    return best.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), (-F.col("x.fewer")).alias("n_equal"), "n_item", "x.begin", "x.end")


def text_name(text: str) -> bytes:
    """Eight bytes that name a passage."""
    return hashlib.blake2b(text.encode(), digest_size=8).digest()


def brute_force(texts: list[str | None], items: list[tuple[int, str | None]]) -> set[tuple[int, int, int]]:
    """(text, item, equal tokens) of each text's best overlap with each passage, over all diagonals with an equal token; for tests."""
    out = set()
    for item, passage in items:
        p = token_hashes(passage or "")
        if not len(p):
            continue
        for i, text in enumerate(texts):
            t = token_hashes(text or "")
            if x := best_overlap(t, 0, p, (np.subtract.outer(np.arange(len(t)), np.arange(len(p)))[np.equal.outer(t, p)]).tolist()):
                out.add((i, item, x[0]))
    return out
