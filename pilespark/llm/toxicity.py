"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_batches

#: Labelled rows that a fit uses at most (chosen by a hash of the id): it bounds what the driver gets.
FIT_ROWS = 20_000
#: Lengths of word beginnings that stand between a word and the whole vocabulary in the hierarchy of priors.
PREFIXES = (4, 5, 6, 7, 8)
#: Pseudo-count of a token's prior; score that every token loses, so that clean text drifts down; least counts kept.
PRIOR, DRIFT, LEAST_TOXIC, LEAST_CLEAN = 1.0, 0.25, 5, 50
#: Occurrences of one word that count in one text, for words come in bursts. In learning only: scoring counts them all.
BURST = 3
#: Expected number of as good segments in clean text of the same length below which a passage is significant.
E_VALUE = 0.05
WORD = re.compile(r"[^\W\d_]+")
MEMO = 200_000
LOG_FACTORIALS = np.array([math.lgamma(n + 1) for n in range(16)])


def nodes(word: str) -> list[str]:
    """The word's place in the hierarchy, from the most general: beginnings, then the whole word."""
    return ["^" + word[:k] for k in PREFIXES if len(word) >= k] + [word]


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.1
    weights: tuple[float, ...] = (-2.0, 1.0, 0.0)

    def score(self, word: str) -> float:
        """Log-odds of the most specific known node, less the drift."""
        for node in reversed(nodes(word)):
            if node in self.odds:
                return self.odds[node] - DRIFT
        return -DRIFT


def log_odds(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Posterior log-odds of each node: Dirichlet-smoothed counts, the prior's centre being the node above."""
    ratio, out = toxic / max(1, clean), {}

    def of(node: str) -> float:
        if node in out:
            return out[node]
        word = node[1:] if node[0] == "^" else node
        above = [x for x in nodes(word) if x != node and (node[0] != "^" or len(x) < len(node)) and x[0] == "^"]
        centre = next((of(x) for x in reversed(above) if x in counts), 0.0)
        t, n = counts[node]
        out[node] = math.log((t + PRIOR * math.exp(centre)) / (n * ratio + PRIOR))
        return out[node]

    for node in counts:
        of(node)
    return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), in linear time.

    Each positive score opens a candidate with the sums left and right of it. A candidate joins the nearest earlier one
    with a smaller left sum if that one's right sum is smaller too; `link` leads from candidate to candidate, so no
    candidate is passed twice.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    begin: list[int] = []
    end: list[int] = []
    link: list[int] = []
    for at in np.flatnonzero(scores > 0).tolist():
        b, e = at, at + 1
        j = len(begin) - 1
        while True:
            while j >= 0 and sums[begin[j]] >= sums[b]:
                j = link[j]
            if j < 0 or sums[end[j]] >= sums[e]:
                begin.append(b)
                end.append(e)
                link.append(j)
                break
            b, after = begin[j], link[j]
            del begin[j:], end[j:], link[j:]
            j = after
    return [(b, e, float(sums[e] - sums[b])) for b, e in zip(begin, end, strict=True)]


def evidence(found: list[tuple[int, int, float]], n: int, model: Model) -> float:
    """-ln of the least p-value over sums of the r best segments, each normalised by length (extreme-value law).

    All segments enter: the sum grows with r only while a segment is worth more than its share of chance.
    """
    scores = model.lam * np.sort(np.array([x[2] for x in found], float))[::-1] - math.log(model.k * max(n, 1))
    r = np.arange(1, len(scores) + 1)
    total = np.cumsum(scores)
    sure = np.flatnonzero(total > r)
    if not len(sure):
        return 0.0
    r, total = r[sure], total[sure]
    return float(max(0.0, np.max(total - (r - 1) * np.log(total) + log_factorial(r) + log_factorial(r - 1) - np.log(r + 1))))


def log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! of whole numbers, by Stirling's series where that is exact to a double."""
    x = np.maximum(n, 16).astype(float)
    series = x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 16, LOG_FACTORIALS[np.minimum(n, 15)], series)


def lower_words(text: str) -> list[str]:
    """The words of a text, each in lower case; a word is found as it stands, for lower case may be longer."""
    lower = text.lower()
    return WORD.findall(lower) if len(lower) == len(text) else [w.lower() for w in WORD.findall(text)]


def features(text: str, model: Model, memo: dict[str, float]) -> tuple[list[str], np.ndarray, list[tuple[int, int, float]], tuple[float, float]]:
    words = lower_words(text)
    get, score = memo.get, model.score
    values = np.empty(len(words))
    for i, w in enumerate(words):
        if (x := get(w)) is None:
            if len(memo) >= MEMO:
                memo.clear()
            x = memo[w] = score(w)
        values[i] = x
    found = segments(values)
    strong = evidence(found, len(words), model)
    return words, values, found, (math.log1p(strong), sum(x[2] for x in found) / max(len(words), 8))


def probability(f: tuple[float, float], model: Model) -> float:
    z = model.weights[0] + model.weights[1] * f[0] + model.weights[2] * f[1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def calibrate(model: Model, sums: Counter, rows: list[tuple[int, int, float]]) -> None:
    """Set lam and k from the clean rows: lam solves E[exp(lam * score)] = 1, k puts the median maximum right."""
    total = sum(sums.values())
    if not total or not any(s > 0 for s in sums) or sum(s * c for s, c in sums.items()) >= 0:
        return
    mean = lambda lam: sum(c * math.exp(min(500.0, lam * s)) for s, c in sums.items()) / total
    low, high = 1e-6, 1.0
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    model.lam = (low + high) / 2
    clean = [math.log(2) * math.exp(min(60.0, model.lam * s)) / n for t, n, s in rows if not t and n]
    model.k = float(min(10.0, max(1e-4, np.median(clean)))) if clean else 0.1


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from labelled documents: labels(id, toxic 0/1), one label an id (the highest, if repeated).

    At most about fit_rows labelled rows are used, chosen by a hash of the id; that bounds the vocabulary and the rows
    of features that reach the driver. Without usable labels, or with one class only, the model finds nothing toxic.
    """
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "toxicity")
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    share = min(1.0, fit_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sample = scratch.keep(texts.join(F.broadcast(known), "id").select("toxic", "text"))  # bounded by fit_rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Counter(lower_words(text))
                mine = seen[toxic == 1]
                mine[""] += sum(min(n, BURST) for n in words.values())
                for w, n in words.items():
                    for node in nodes(w):
                        mine[node] += min(n, BURST)
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][x] for x in keys], pa.int64()), pa.array([seen[0][x] for x in keys], pa.int64())], names=["node", "t", "n"])

    counted = sample.mapInArrow(count, "node string, t long, n long").groupBy("node").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    counts = {r[0]: (r[1], r[2]) for r in counted.where((F.col("t") >= LEAST_TOXIC) | (F.col("n") >= LEAST_CLEAN)).collect()}
    toxic, clean = counts.pop("", (0, 0))
    if not toxic or not clean:
        scratch.drop(sample)
        return Model(weights=(-30.0, 0.0, 0.0))
    model = Model(odds=log_odds(counts, toxic, clean))

    def collect(model: Model, with_scores: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo: dict[str, float] = {}
            for batch in batches:
                out, sums = [], Counter()
                for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words, values, found, f = features(text, model, memo)
                    out.append((int(t), len(words), max((x[2] for x in found), default=0.0), *f))
                    if with_scores and not t:
                        sums.update(np.round(values, 1).tolist())
                out += [(-1, n, s, 0.0, 0.0) for s, n in sums.items()]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)] if out else [pa.array([], kind) for kind in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())], names=["t", "n", "s", "f1", "f2"])

        return sample.mapInArrow(run, "t long, n long, s double, f1 double, f2 double").collect()

    rows, sums = [], Counter()
    for r in collect(model, True):
        if r["t"] < 0:
            sums[r["s"]] += r["n"]
        else:
            rows.append((r["t"], r["n"], r["s"]))
    calibrate(model, sums, rows)
    rows = collect(model, False)
    scratch.drop(sample)
    y = np.array([r["t"] for r in rows], float)
    model.weights = logistic(np.array([[r["f1"], r["f2"]] for r in rows]), y)
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, passages array<struct<start, end, e_value>> of each row's whole text.

    One pass without a shuffle. A passage is a maximal segment expected less than E_VALUE times in clean text of the
    same length, as code-point offsets; every occurrence of a word counts, wherever it stands. Null and empty texts get
    the score of a text without evidence and no passages; every row gives a row, with null or repeated ids kept; an
    empty table gives none; other columns are not read.
    """
    text_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                words, _, found, f = features(text, model, memo)
                scores.append(probability(f, model))
                strong = [(b, e, x) for b, e, s in found if (x := model.k * max(len(words), 1) * math.exp(-model.lam * s)) < E_VALUE]
                places = [m.span() for m in WORD.finditer(text)] if strong else []
                passages.append([{"start": places[b][0], "end": places[e - 1][1], "e_value": x} for b, e, x in strong])
            score = pa.array(scores, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), score, pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, kind)], names=["doc_id", "score", "predicted", "passages"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, passages array<struct<start: bigint, end: bigint, e_value: double>>")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text the model predicts to be toxic: all columns, no shuffle.

    Null and empty texts have no evidence and stay, as do rows with null ids; rows that repeat share one fate.
    """
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([probability(features(t or "", model, memo)[3], model) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether an id is kept from learning: crc32 of its text is divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
