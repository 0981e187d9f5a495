"""Line, document and byte-string deduplication against brute force."""

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pilespark.llm import common, line_dedup, ngram_join, suffix_dedup

DOCS = "doc_id long, text string, source string, n_removed long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(n))


def near(rng, text, k):
    parts = text.split(" ")
    for _ in range(k):
        parts[rng.randrange(len(parts))] = f"edit{rng.randrange(10**6)}"
    return " ".join(parts)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(40)]
    texts += [texts[3]] * 4 + [near(rng, texts[k % 40], 1 + k % 3) for k in range(60)]
    texts += [None, "", "   ", "one", "one", "x" * 700, "ab" * 400, "ab" * 400]
    base = words(rng, 150)
    texts += [near(rng, base, 2) for _ in range(90)]
    return texts


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_ngram_join_equals_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 32)
    rows = [(i, t, "s", 1) for i, t in enumerate(corpus)] + [(None, "no id", "s", 1)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(spark.createDataFrame(rows, DOCS)).collect()}
    sets = []
    for t in corpus:
        w = (t or "").lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    want = {i: (c, count[i]) for i, c in enumerate(classes(len(sets), links))}
    assert got == want


def test_ngram_join_keeps_short_pairs(spark):
    """Pairs of 8 common shingles of 10 in all, which sketches of few shingles misjudge."""
    rng = random.Random(6)
    rows = []
    for i in range(300):
        parts = [f"p{i}q{rng.randrange(10**6)}" for _ in range(13)]
        rows += [(2 * i, " ".join(parts), "s", 0), (2 * i + 1, " ".join(["x", *parts[1:]]), "s", 0)]
    found = {r["doc_id"]: r["n_links"] for r in ngram_join.ngram_join(spark.createDataFrame(rows, DOCS)).collect()}
    assert [x for x, n in found.items() if n != 1] == []


def test_ngram_join_of_odd_rows(spark):
    """Repeated ids, a very long text, and columns that clash with those of the result."""
    rng = random.Random(14)
    long = words(rng, 30_000, 4000)
    rows = [(1, "a b c d e f", "s", 0), (1, "a b c d e f", "s", 0), (2, "A b  c d e f", "s", 0), (3, long, "s", 0), (4, long + " tail", "s", 0), (5, None, "s", 0), (6, " ", "s", 0)]
    frame = spark.createDataFrame(rows, DOCS).withColumnRenamed("source", "class_id").withColumnRenamed("n_removed", "n_links")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(frame).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (3, 1), 5: (5, 0), 6: (6, 0)}


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_join(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    long = [words(rng, rng.randrange(25, 50)) for _ in range(40)]
    pool = long + [words(rng, rng.randrange(1, 9)) for _ in range(20)] + ["a", "The.", "短い行です。"]
    pool += [near(rng, rng.choice(long), 1) for _ in range(60)] + [""]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(80)] + [None, "", " \n "]
    rows = [(i, t, "s", 99) for i, t in enumerate(texts)] + [(None, "no id at all\n" + pool[0], "s", 99)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    got = {r["doc_id"]: r for r in out.collect()}
    lines = [(i, k, x) for i, t in enumerate(texts) if t is not None for k, x in enumerate(t.split("\n")) if x.strip()] + [(len(texts), k, x) for k, x in enumerate(rows[-1][1].split("\n"))]
    distinct = sorted({x for _, _, x in lines})
    sets = {x: {x[k : k + line_dedup.SHINGLE] for k in range(max(1, len(x) - line_dedup.SHINGLE + 1))} for x in distinct}
    links = [(a, b) for a in range(len(distinct)) for b in range(a) if len(sets[distinct[a]] & sets[distinct[b]]) >= 0.8 * len(sets[distinct[a]] | sets[distinct[b]])]
    root = dict(zip(distinct, classes(len(distinct), links), strict=True))
    seen, kept = set(), defaultdict(list)
    for i, k, x in lines:
        if root[x] not in seen:
            seen.add(root[x])
            kept[i].append(k)
    for i, t in enumerate(texts):
        if t is None:
            assert got[i]["text"] is None and got[i]["n_lines"] == 0
            continue
        parts = t.split("\n")
        want = [x for k, x in enumerate(parts) if not x.strip() or k in kept[i]]
        assert got[i]["text"] == "\n".join(want)
        assert got[i]["n_lines"] == len(parts) and got[i]["n_removed"] == len(parts) - len(want)
    assert got[None]["n_removed"] == (pool[0] in {x for i, _, x in lines if i < len(texts)})


def test_lines_are_alike_by_all_their_substrings(spark):
    """Edits that touch most words' beginnings, or none of them: what counts is every substring."""
    grams = lambda x: {x[k : k + line_dedup.SHINGLE] for k in range(max(1, len(x) - line_dedup.SHINGLE + 1))}
    rng = random.Random(8)
    letters = "".join(map(chr, range(97, 123)))
    rows, want = [], []
    for i in range(120):
        a = " ".join("".join(rng.choices(letters, k=rng.randrange(4, 15))) for _ in range(rng.randrange(8, 16)))
        at = rng.randrange(len(a))
        b = a[:at] + "#" + a[at + 1 :]
        rows += [(2 * i, a, "s", 0), (2 * i + 1, b, "s", 0)]
        want.append(len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)))
    assert any(want) and not all(want)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[2 * i + 1] == 1 for i in range(120)] == want


def test_bitmaps_rule_out_no_like_lines(spark):
    rng = random.Random(5)
    lines = ["", "a", "short", "ab" * 400]
    for n in (12, 60, 700, 3000):
        base = [rng.choice("abcdefgh ") for _ in range(n)]
        for edits in (0, 1, n // 100, n // 60, n // 20, n):
            line = list(base)
            for _ in range(edits):
                line[rng.randrange(n)] = rng.choice("xyz")
            lines.append("".join(line))
    held = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    rows = line_dedup.bitmaps(held).join(held, "id").withColumn("set", line_dedup.shingles(F.col("line")))
    names = [c for c in rows.columns if c not in ("id", "line", "set")]
    a, b = rows.alias("a"), rows.alias("b")
    room = line_dedup.may_be_alike(*({c: F.col(f"{x}.{c}") for c in names} for x in "ab"), 0.8)
    pairs = a.join(b, F.col("a.id") < F.col("b.id")).select(room.alias("room"), line_dedup.alike(F.col("a.set"), F.col("b.set"), 0.8).alias("like"), F.col("a.line").alias("x"), F.col("b.line").alias("y"))
    grams = lambda t: {t[i : i + 9] for i in range(max(1, len(t) - 8))}
    found = 0
    for r in pairs.collect():
        x, y = grams(r.x), grams(r.y)
        assert r.like == (len(x & y) / len(x | y) >= 0.8)
        assert r.room or not r.like
        found += r.like
    assert found > 4


def test_like_lines_meet_in_a_crowded_family(spark, monkeypatch):
    """Lines of one template share bands and are unlike each other; only the planted pairs are alike."""
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    grams = lambda x: {x[k : k + line_dedup.SHINGLE] for k in range(len(x) - line_dedup.SHINGLE + 1)}
    alike = lambda a, b: len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b))
    rng = random.Random(9)
    frame = words(rng, 40)
    family = [frame + " " + "".join(rng.choices("bcdfghjk", k=60)) for _ in range(600)]
    copies = [x[:40] + "#" + x[41:-15] + "z" + x[-14:] for x in family[:200]]
    assert all(alike(a, b) for a, b in zip(family, copies, strict=False)) and not any(alike(family[0], x) for x in family[1:])
    found = line_dedup.line_dedup(spark.createDataFrame([(i, x, "s", 0) for i, x in enumerate(family + copies)], DOCS)).collect()
    gone = {r["doc_id"] for r in found if r["n_removed"]}
    assert gone == set(range(600, 800))


def test_line_dedup_of_odd_lines(spark):
    """White space, carriage returns, rows that repeat, null ids, and a very long line."""
    long = words(random.Random(12), 30_000)
    same = "a line that stands twice here"
    rows = [(1, "first\r\n\r\n\t\n \u000b\nsecond\r", "s", 0), (2, "\r\n\r\n", "s", 0), (3, long, "s", 0), (4, long[:-9] + "z" * 9, "s", 0)]
    rows += [(5, f"{same}\n{same}", "s", 0)] * 2 + [(None, same, "s", 0), (None, None, "s", 0), (6, "", "s", 0)]
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()]
    want = [(1, rows[0][1], 5, 0), (2, "\r\n\r\n", 3, 0), (3, long, 1, 0), (4, "", 1, 1), (5, same, 2, 1), (5, same, 2, 1), (None, "", 1, 1), (None, None, 0, 0), (6, "", 1, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_line_dedup_finds_links_in_large_clusters(spark):
    """Clusters of hundreds and lines of 3 to 60 words at 0.8 to 0.9: at least 0.97 of the linked lines go."""
    grams = lambda x: {x[k : k + line_dedup.SHINGLE] for k in range(max(1, len(x) - line_dedup.SHINGLE + 1))}
    like = lambda a, b: len(a & b) / len(a | b)
    rng = random.Random(11)
    pairs = []
    while len(pairs) < 300:
        a = words(rng, rng.randrange(3, 61), 4000)
        b = a
        while like(grams(a), grams(b)) > 0.9:
            at = rng.randrange(len(b))
            b = b[:at] + rng.choice("qzj#") + b[at + 1 :]
        if like(grams(a), grams(b)) >= 0.8:
            pairs += [a, b]
    base = words(rng, 40, 4000)
    crowd = [near(rng, base, 1 + k % 4) for k in range(300)]
    lines = sorted(set(pairs + crowd), key=(pairs + crowd).index)
    sets = [grams(x) for x in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and like(sets[i], sets[j]) >= 0.8]
    root = classes(len(lines), links)
    want = {i for i, r in enumerate(root) if i != r}
    got = {r["doc_id"] for r in line_dedup.line_dedup(spark.createDataFrame([(i, x, "s", 0) for i, x in enumerate(lines)], DOCS)).collect() if r["n_removed"]}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 300


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("hot", [2048, 3])
def test_suffix_dedup_equals_brute_force(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(3)
    passage = words(rng, 60)
    texts = [*corpus, *(words(rng, 20) + " " + passage[k % 30 :] + " é " + words(rng, 15) for k in range(30)), "z" * 199, "z" * 200]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)]
    found = suffix_dedup.digest(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, DOCS)))
    got = [tuple(r)[1:] for r in found.orderBy("doc_id").collect()]
    assert got == suffix_dedup.brute_force(texts)


def test_suffix_dedup_tells_apart_rows_that_repeat(spark):
    text = words(random.Random(1), 90)
    rows = [(1, text, "s", 1), (1, text, "s", 1), (1, "short", "s", 1), (None, text[:300], "s", 1)]
    got = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digest(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, DOCS))).collect())
    assert got == sorted([(len(text), len(text))] * 2 + [(5, 0), (300, 300)])
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_deep_shallow_sorts(spark):
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    strings += [b"a" * n for n in range(50)] + [b"q" * 40 + s for s in strings[:80]]
    order, shared = suffix_dedup.deep_shallow(strings)
    assert [strings[i] for i in order] == sorted(strings)
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[k] == n


def test_halves_of_hashes_lose_no_pair():
    # 8 of 10 hashes are common, but two of the common ones share their lower half
    one, other = np.arange(10, dtype=np.uint64), np.concatenate([np.arange(8), [100, 101]]).astype(np.uint64)
    one[0] = other[0] = 1 + 2**40
    sets, far = [one, other], np.ones((2, ngram_join.SKETCH), np.uint8) * np.array([[1], [2]], np.uint8)
    whole = [ngram_join.halves(x).tobytes() for x in sets]
    assert [len(x) for x in whole] == [36, 36]
    assert ngram_join.proposed(np.array([10.0, 10.0]), far, whole, 8 / 12).all()


def test_a_kept_table_leaves_no_shuffle_files(spark):
    files = lambda: {str(f) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString() for f in Path(d).rglob("shuffle_*")}
    before, scratch = files(), common.Scratch(spark, "test")
    a, b = (scratch.keep(spark.range(1000).groupBy((F.col("id") % k).alias("id")).count()) for k in (7, 9))
    assert not files() - before and (a.count(), b.count()) == (7, 9)
    scratch.only(b)
    assert not Path(a._scratch_path).exists() and b.count() == 9


def test_components(spark):
    from pilespark.llm.common import Scratch, components

    edges = [(k, k + 1) for k in range(40)] + [(100, 50 + k) for k in range(30)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in components(spark, spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 50 for k in [*range(50, 80), 100])
    assert got[200] == 200 and got[301] == 300


def test_word_hashes_tell_words_apart():
    import numpy as np

    from pilespark.llm.shingles import words as hashes

    rng = random.Random(9)
    text = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(3000)} | {"y" * n for n in range(1, 60)} | {"é" * n for n in range(1, 9)}
    found = hashes(np.frombuffer(" ".join(sorted(text)).encode(), np.uint8))
    assert len(found) == len(set(found.tolist())) == len(text)
    assert hashes(np.frombuffer(b"  one\ttwo\none ", np.uint8)).tolist() == [*hashes(np.frombuffer(b"one two one", np.uint8)).tolist()]


def test_tables_of_few_rows_are_few_files(spark, monkeypatch, tmp_path):
    """Whether or not adaptive execution puts partitions together."""
    monkeypatch.setattr(common, "scratch_root", lambda spark: str(tmp_path))
    monkeypatch.setattr(common.Scratch, "_remove", lambda self, path: None)
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    lines = [" ".join(f"w{(7 * k + j) ** 3 % 101}" for j in range(12)) + end for k in range(40) for end in ("", ".")]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = common.Scratch(spark, "few").keep(spark.range(300).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 10).alias("b")), 300)
        roots = common.components(spark, edges, common.Scratch(spark, "few"), 300).collect()
        found = line_dedup.line_dedup(spark.createDataFrame([(i, x, "s", 0) for i, x in enumerate(lines)], DOCS)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["node"], r["root"]) for r in roots) == [(i, i - i % 10) for i in range(300)]
    assert sum(r["n_removed"] for r in found) >= 40
    count = lambda name: [len(list(t.glob("part-*"))) for d in tmp_path.glob(f"pilespark-{name}-*") for t in d.iterdir()]
    assert max(count("few")) == 1
    assert len(count("lines")) > 15 and sum(n > 4 for n in count("lines")) <= 5  # those with texts, signatures and comparisons


def test_signatures_compute_a_lines_bound_once(spark):
    """Not for each of its substrings, as it was beside explode()."""
    plan = line_dedup.signatures(spark.createDataFrame([(1, "a line", "s", 0)], DOCS))._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x and "xxhash64(substring" in x]
    assert len(filters) == 1 and "bound" in filters[0] and "least(" not in filters[0]


def test_minima_and_words_are_filtered(spark):
    """A row of a substring changes one bin or word, and no CASE writes the others, as it did before."""
    held = spark.createDataFrame([(1, "a line of some words")], "id long, line string")
    for df in (line_dedup.signatures(held.select(F.col("line").alias("text"))), line_dedup.bitmaps(held)):
        first = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate" in x and "partial_" in x]
        assert first and all("FILTER (WHERE" in x and "CASE WHEN" not in x for x in first)


def test_blank_lines_are_those_without_a_non_space(spark):
    texts = ["", " ", "\t\r\f\x0b \n", "\r", " x", "x ", " ", "  ", "\x1c", "\x85", "\x00", " \t.", "é", None]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", line_dedup.blank(F.col("x")).alias("blank"), (~F.col("x").rlike(r"\S")).alias("want")).collect()
    assert [r["blank"] for r in got] == [r["want"] for r in got]
    assert [r["blank"] for r in got][:4] == [True] * 4 and not any(r["blank"] for r in got[4:])
