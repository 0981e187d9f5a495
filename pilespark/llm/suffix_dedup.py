"""Removal of byte strings that repeat across or within documents, by sorting suffixes that share an anchor."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, text_batches
from .common import small as small_up_to
from .shingles import BYTES, mix

#: Bytes of a string that counts as repeated, and of an anchor gram; windows that are hashed at once.
LENGTH, GRAM, SLICE = 200, 40, 1 << 20
#: Depth in bytes to which strings are sorted by multikey quicksort, eight bytes a step, before blind tries take over.
SHALLOW = 16
#: Contexts of one anchor that one task sorts; larger groups are split by what halves of their windows must share.
HOT = 2048
#: Rows, or entries of arrays, of a few numbers that may be broadcast.
BROADCAST_ROWS = 1_000_000


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each position on, by doubling."""
    h, out, width, step = BYTES[data], None, 0, 1
    while True:
        if n & step:
            if out is None:
                out, width = h, step
            else:
                m = len(data) - width - step + 1
                out = out[:m] * np.uint64(0x9E6C63D0876A9A47) + h[width : width + m]
                width += step
        if 2 * step > n:
            return mix(out)
        m = len(h) - step
        h = h[:m] * (mix(np.array([step], np.uint64))[0] | np.uint64(1)) + h[step : step + m]
        step *= 2


def window_minima(h: np.ndarray, n: int) -> np.ndarray:
    """Least of the n values from each position on, by doubling."""
    step = 1
    while 2 * step <= n:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (n - step)], h[n - step :])


def units(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, context hash, first window, windows, anchor's distance from the first window), slice by slice.

    The anchor of a LENGTH-byte window is its gram of least hash, the leftmost of equals: equal windows have equal
    anchors at equal places. A unit is a run of windows with one anchor; its context is all bytes that they cover.
    """
    rest = np.uint64((1 << 24) - 1)
    for begin in range(0, len(data) - LENGTH + 1, SLICE):
        part = data[begin : begin + SLICE + LENGTH - 1]
        h = gram_hashes(part, GRAM)
        place = (window_minima(h & ~rest | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1) & rest).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        n = np.diff(np.concatenate([first, [len(place)]]))
        sums = gram_hashes(part, LENGTH)  # a context is told by its first and last window, and its length
        ctx = mix(sums[first] * np.uint64(3) + mix(sums[first + n - 1]) + n.astype(np.uint64))
        yield h[place[first]], ctx, begin + first, n, place[first] - first


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree up to `at`."""
    end = min(len(a), len(b))
    if a[at:end] == b[at:end]:
        return end
    low, high = at, end
    while high - low > 1:  # agree up to low, differ before high
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Strings by their branching bytes only; a node is [depth, {byte: node or leaf}], a leaf a list of strings' numbers."""

    def __init__(self, strings: list[bytes], depth: int):
        self.strings, self.depth, self.root = strings, depth, None

    def byte(self, s: bytes, at: int) -> int:
        return s[at] if at < len(s) else -1

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):  # blindly to some leaf
            node = node[1].get(self.byte(s, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        n = common_prefix(s, other, self.depth)
        if n == len(s) == len(other):
            node.append(i)
            return
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < n:
            above, node = node, node[1][self.byte(s, node[0])]
        if isinstance(node, tuple) and node[0] == n:
            node[1][self.byte(s, n)] = [i]
            return
        new = (n, {self.byte(other, n): node, self.byte(s, n): [i]})
        if above is None:
            self.root = new
        else:
            above[1][self.byte(s, above[0])] = new

    def walk(self, order: list[int], shared: list[int]) -> None:
        """Append the strings in order, and what each shares with the one before it (the first: nothing new)."""
        stack: list = [(self.root, None)]
        while stack:
            node, before = stack.pop()
            if isinstance(node, list):
                for k, i in enumerate(node):
                    order.append(i)
                    shared.append(len(self.strings[i]) if k else before)
            else:
                children = [node[1][c] for c in sorted(node[1])]
                stack += [(c, node[0]) for c in reversed(children[1:])]
                stack.append((children[0], before))


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """(order, shared): the strings' numbers in byte order, and each one's common prefix with the one before it.

    Multikey quicksort takes eight bytes at a time down to SHALLOW; groups that still agree have a long common prefix
    and are ordered by a blind trie. A string that ends goes before those that go on.
    """
    order: list[int] = []
    shared: list[int] = []
    stack = [(list(range(len(strings))), 0, 0)]
    while stack:
        group, depth, before = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            shared.append(before)
        elif depth >= SHALLOW:
            trie = BlindTrie(strings, depth)
            for i in group:
                trie.insert(i)
            at = len(order)
            trie.walk(order, shared)
            shared[at] = before
        else:
            keys = [strings[i][depth : depth + 8] for i in group]
            pivot = sorted(keys[:: max(1, len(keys) // 9)])[len(keys[:: max(1, len(keys) // 9)]) // 2]
            low = [i for i, k in zip(group, keys, strict=True) if k < pivot]
            same = [i for i, k in zip(group, keys, strict=True) if k == pivot]
            high = [i for i, k in zip(group, keys, strict=True) if k > pivot]
            if len(pivot) < 8:  # equal and at their end
                low, same, ended = low, same[:1], same[1:]
            else:
                ended = []
            if high:
                stack.append((high, depth, None))
            if ended:
                stack += [([i], depth, len(pivot) + depth) for i in ended]
            stack.append((same, depth + 8 if len(pivot) == 8 else depth, None if low else before))
            if low:
                stack.append((low, depth, before))
            continue
    for k in range(1, len(order)):
        if shared[k] is None:  # where two parts meet, their strings differ within SHALLOW bytes or soon after
            shared[k] = common_prefix(strings[order[k - 1]], strings[order[k]], 0)
    if shared:
        shared[0] = 0
    return order, shared


def mutual(strings: list[bytes]) -> np.ndarray:
    """Common prefix of each two strings: the least of what neighbours share between them in sorted order."""
    order, shared = deep_shallow(strings)
    n = len(order)
    out = np.zeros((n, n), np.int32)
    lengths = np.array(shared, np.int32)
    for k in range(n - 1):
        out[k, k + 1 :] = np.minimum.accumulate(lengths[k + 1 :])
    out += out.T
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return out[np.ix_(back, back)]


def shared_windows(contexts: list[tuple[bytes, int]], first: int, last: int) -> list[list[tuple[int, int]]]:
    """For each (context, anchor) of one key, the byte runs covered by windows that another context has too.

    Two contexts share the window that begins o bytes before the anchor if they agree on o bytes to the left and on
    LENGTH - o from the anchor on. Windows of first <= o <= last are looked at.
    """
    left = mutual([c[:a][::-1] for c, a in contexts])
    right = mutual([c[a + GRAM :] for c, a in contexts]) + GRAM
    low, high = np.maximum(first, LENGTH - right), np.minimum(left, last)
    fits = low <= high
    np.fill_diagonal(fits, False)
    out = []
    for i, (_, a) in enumerate(contexts):
        js = np.flatnonzero(fits[i])
        runs: list[tuple[int, int]] = []
        if len(js):
            for lo, hi in sorted(set(zip(low[i, js].tolist(), high[i, js].tolist(), strict=True))):
                b, e = a - hi, a - lo + LENGTH
                runs.append((b, e))
        out.append(merged(runs))
    return out


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open runs, touching ones joined."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(runs):
        if out and b <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((b, e))
    return out


def key_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(first `width` columns, rows) of consecutive rows that agree in them."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != now:
                if held:
                    yield now, held
                now, held = row[:width], []
            held.append(row)
    if held:
        yield now, held


def small(df: DataFrame, array: str | None = None) -> DataFrame:
    return small_up_to(df, BROADCAST_ROWS, array)


def frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


RUNS = pa.schema([("doc", pa.int64()), ("salt", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())])
RUNS_SQL = "doc long, salt int, begin int, end int"


def repeated_runs(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs(doc, salt, text) -> (doc, salt, begin, end): byte runs covered by repeated strings, some overlapping."""
    spark = docs.sparkSession
    kinds = {"key": pa.int64(), "ctx": pa.int64(), "doc": pa.int64(), "salt": pa.int32(), "begin": pa.int32(), "n": pa.int32(), "at": pa.int32()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in kinds]
            owners: list[tuple] = []
            for doc, salt, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for key, ctx, begin, n, at in units(np.frombuffer(text.encode(), np.uint8)):
                    for k, x in zip((0, 1, 4, 5, 6), (key.view(np.int64), ctx.view(np.int64), begin, n, at), strict=True):
                        out[k].append(x)
                    owners.append((doc, salt, len(key)))
            if owners:
                cat = [np.concatenate(x) if x else None for x in out]
                cat[2] = [d for d, _, n in owners for _ in range(n)]
                cat[3] = [s for _, s, n in owners for _ in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cat, kinds.values(), strict=True)], names=list(kinds))

    every = scratch.keep(docs.where(F.octet_length("text") >= LENGTH).mapInArrow(scan, "key long, ctx long, doc long, salt int, begin int, n int, at int"))
    keys = scratch.keep(every.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key"))
    again = scratch.keep(every.join(small(keys), "key", "left_semi"))
    scratch.drop(every)
    contexts = scratch.keep(again.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "salt", "begin", "n", "at")).alias("x")))
    # a context that occurs twice is repeated throughout
    known = again.join(small(scratch.keep(contexts.where("times > 1").select("key", "ctx"))), ["key", "ctx"], "left_semi").select("doc", "salt", "begin", (F.col("begin") + F.col("n") + (LENGTH - 1)).alias("end"))
    # different contexts of one key may share some windows
    many = scratch.keep(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    open_ones = contexts.join(small(many), "key").select("x.doc", "x.salt", F.struct("key", "size", (F.col("times") == 1).alias("single"), "x.begin", "x.n", "x.at").alias("x"))
    asked = scratch.keep(open_ones.groupBy("doc", "salt").agg(F.collect_list("x").alias("asked")))
    text_schema = pa.schema([("key", pa.int64()), ("size", pa.int64()), ("doc", pa.int64()), ("salt", pa.int32()), ("begin", pa.int32()), ("at", pa.int32()), ("single", pa.bool_()), ("context", pa.binary())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, salt, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                rows += [(x["key"], x["size"], doc, salt, x["begin"], x["at"], x["single"], data[x["begin"] : x["begin"] + x["n"] + LENGTH - 1]) for x in wanted]
            yield frame(rows, text_schema)

    named = asked.select(F.col("doc").alias("d"), F.col("salt").alias("s"), "asked")
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("salt") == F.col("s"))
    fetched = docs.join(small(named, "asked"), same).select("doc", "salt", "text", "asked").mapInArrow(fetch, "key long, size long, doc long, salt int, begin int, at int, single boolean, context binary")
    fetched = scratch.keep(fetched)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for (_, first, last), group in key_groups(batches, 3):
            group = list({g[3:6]: g for g in group}.values())  # rows that repeat id and text hold the same contexts
            for (_, _, _, doc, salt, begin, _, single, _), runs in zip(group, shared_windows([(g[8], g[6]) for g in group], first, last), strict=True):
                if single:
                    rows += [(doc, salt, begin + b, begin + e) for b, e in runs]
            if len(rows) >= 10_000:
                yield frame(rows, RUNS)
                rows = []
        yield frame(rows, RUNS)

    split_schema = pa.schema([("key", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), *(text_schema.field(k) for k in ("doc", "salt", "begin", "at", "single", "context"))])
    split_sql = "key long, first int, last int, doc long, salt int, begin int, at int, single boolean, context binary"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A context goes to the groups of those that agree with it on all that the windows of half the range share.

        There it is cut down to what these windows cover.
        """
        for batch in batches:
            rows = []
            for key, first, last, doc, salt, begin, at, single, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                middle = (first + last) // 2
                for lo, hi in ((first, middle), (middle + 1, last)):
                    if at >= lo and len(context) - at >= LENGTH - hi:
                        child = hashlib.blake2b(context[at - lo : at + LENGTH - hi] + f"{key} {lo} {hi}".encode(), digest_size=8).digest()
                        cut = max(0, at - hi)
                        rows.append((int.from_bytes(child, "little", signed=True), lo, hi, doc, salt, begin + cut, at - cut, single, context[cut : at + LENGTH - lo]))
            yield frame(rows, split_schema)

    out = known
    columns = ["key", "first", "last", "doc", "salt", "begin", "at", "single", "context"]
    groups = fetched.withColumns({"first": F.lit(0), "last": F.lit(LENGTH - GRAM)})
    while True:
        cool = groups.where(F.col("size") <= HOT).select(columns)
        out = out.union(cool.repartition(partitions(spark), "key").sortWithinPartitions("key", "first").mapInArrow(solve, RUNS_SQL))
        hot = groups.where((F.col("size") > HOT) & (F.col("first") < F.col("last")))  # one window: all unlike once cut down
        if hot.isEmpty():
            return out
        parts = scratch.keep(hot.select(columns).mapInArrow(split, split_sql).withColumn("name", F.xxhash64("context")))
        # cut down, many are equal: those are repeated throughout, and one of them stands for all
        place = F.struct("doc", "salt", "begin", "at", "single", "context")
        distinct = scratch.keep(parts.groupBy("key", "name", "first", "last").agg(F.min(place).alias("x"), F.count(F.lit(1)).alias("times")))
        equal = distinct.where("times > 1").select("key", "name")
        out = out.union(parts.where("single").join(small(equal), ["key", "name"], "left_semi").select("doc", "salt", "begin", (F.col("begin") + F.length("context")).alias("end")))
        sizes = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        single = (F.col("x.single") & (F.col("times") == 1)).alias("single")
        groups = scratch.keep(distinct.join(small(sizes), "key").select("key", "size", "first", "last", "x.doc", "x.salt", "x.begin", "x.at", single, "x.context"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans array<struct<begin, end>>, kept binary: each text without its repeated strings.

    Each byte goes that lies in a LENGTH-byte string (of the UTF-8 text) that also starts at another place of any row;
    spans are the maximal runs of such bytes. The result is exact, up to collisions of two 64-bit hashes at once: every
    window is led to its anchor, anchors that occur once are dropped, equal contexts are settled by counting, and what
    is left is sorted around each anchor. Null and empty texts have no bytes. Rows that repeat an id are told apart by
    their text; rows that repeat both are copies of each other. Null ids are kept; other columns are not read.
    """
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "suffixes")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("doc", F.hash("text").alias("salt"), "text")
    runs = repeated_runs(rows, scratch)

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        kind = pa.schema([("d", pa.int64()), ("s", pa.int32()), ("runs", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])
        for (doc, salt), group in key_groups(batches, 2):
            out.append((doc, salt, [{"begin": b, "end": e} for b, e in merged([g[2:] for g in group])]))
            if len(out) >= 2_000:
                yield frame(out, kind)
                out = []
        yield frame(out, kind)

    spans = scratch.keep(runs.repartition(partitions(spark), "doc", "salt").sortWithinPartitions("doc", "salt").mapInArrow(join_runs, "d long, s int, runs array<struct<begin: int, end: int>>"))
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("salt") == F.col("s"))
    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, gone = text.encode(), gone or []
                edges = [0, *(x for r in gone for x in (r["begin"], r["end"])), len(data)]
                out.append((doc, len(data), gone, b"".join(data[b:e] for b, e in zip(edges[::2], edges[1::2], strict=True))))
            yield frame(out, result)

    return rows.join(small(spans, "runs"), same, "left").select("doc", "text", "runs").mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<begin: int, end: int>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of suffix_dedup()."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["begin"]).cast("long"))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each text, by a dictionary of all strings; for tests."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - LENGTH + 1):
            seen[d[i : i + LENGTH]] = seen.get(d[i : i + LENGTH], 0) + 1
    out = []
    for d in data:
        runs = merged([(i, i + LENGTH) for i in range(len(d) - LENGTH + 1) if seen[d[i : i + LENGTH]] > 1])
        edges = [0, *(x for r in runs for x in r), len(d)]
        kept = b"".join(d[b:e] for b, e in zip(edges[::2], edges[1::2], strict=True))
        out.append((len(d), len(d) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out
