"""Operators on the worked cases of FIXTURES.md, and the pileup against its plain form."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pilespark.operators import asof, kmer, merge, partition, pileup, ranges, stratum

READS = "read_id long, seq string, qual string, alignments string"


def rows_of(spark, reads, contigs, make=pileup.pileup):
    found = make(spark.createDataFrame(reads, READS), spark.createDataFrame(contigs, "contig string, seq string"))
    return sorted(tuple(r) for r in found.select("pos", "ref", "depth", "bases", "quals").collect())


@pytest.mark.parametrize(("seq", "qual", "alignment", "contig", "rows"), [
    ("ACTTA", "IIIII", "c1:+:3:2G2", "NNACGTA", [(3, "A", ".", "I"), (4, "C", ".", "I"), (5, "G", "T", "I"), (6, "T", ".", "I"), (7, "A", ".", "I")]),
    ("ACTTA", "ABCDE", "c1:-:3:2G2", "NNTACGT", [(3, "T", ",", "E"), (4, "A", ",", "D"), (5, "C", "a", "C"), (6, "G", ",", "B"), (7, "T", ",", "A")]),
    ("ACGT", "IIII", "c1:+:10:2>1+2", "N" * 9 + "ACTGT", [(10, "A", ".", "I"), (11, "C", ".-1T", "I"), (12, "T", "*", "*"), (13, "G", ".", "I"), (14, "T", ".", "I")]),
    ("ACGGT", "ABCDE", "c1:+:10:2>1-2", "N" * 9 + "ACGT", [(10, "A", ".", "A"), (11, "C", ".+1G", "B"), (12, "G", ".", "D"), (13, "T", ".", "E")]),
    ("NNACG", "12ABC", "c1:+:3:(2)3", "NNACG", [(3, "A", ".", "A"), (4, "C", ".", "B"), (5, "G", ".", "C")]),
    ("ACGT", "IIII", "c1:+:1:2>1+>1-2", "ACGTACGT", []),
    ("ACGT", "IIII", "-", "ACGT", []),
])
def test_pileup_cases(spark, seq, qual, alignment, contig, rows):
    want = [(p, r, 1, b, q) for p, r, b, q in rows]
    for make in (pileup.pileup, pileup.pileup_by_function):
        assert rows_of(spark, [(1, seq, qual, alignment)], [("c1", contig)], make) == want


def random_read(rng, genome):
    """A read and its alignment, made by walking along the genome."""
    strand = rng.choice("+-")
    other = str.maketrans("ACGT", "TGCA")
    tokens, seq, used, n = [], "", 0, rng.randrange(2, 6)
    start = rng.randrange(1, len(genome) - 80)
    parts = []
    for k in range(n):
        run = rng.randrange(1, 9)
        kind = rng.choice(["", "", "+", "-"]) if k < n - 1 else ""
        parts.append((run, kind, rng.randrange(1, 4)))
    span = sum(r + (g if kind == "+" else 0) for r, kind, g in parts) + n - 1
    place = lambda: genome[start - 1 + used] if strand == "+" else genome[start - 1 + span - 1 - used]
    shown = lambda c: c if strand == "+" else c.translate(other)
    for k, (run, kind, gap) in enumerate(parts):
        for _ in range(run):
            seq += shown(place())
            used += 1
        tokens.append(f"{run}>{gap}{kind}" if kind else str(run))
        if kind == "+":
            used += gap
        elif kind == "-":
            seq += "".join(rng.choice("ACGT") for _ in range(gap))
        if k < n - 1:
            base = place()
            seq += rng.choice([c for c in "ACGT" if c != shown(base)])
            tokens.append(shown(base))
            used += 1
    if rng.random() < 0.3:
        seq, tokens = "NN" + seq, ["(2)", *tokens]
    if rng.random() < 0.3:
        seq, tokens = seq + "NNN", [*tokens, "(3)"]
    return seq, "".join(chr(34 + rng.randrange(80)) for _ in seq), f"c1:{strand}:{start}:{''.join(tokens)}", start, span


def test_pileup_forms_agree(spark):
    rng = random.Random(11)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    reads = [(i, *random_read(rng, genome)) for i in range(300)]
    frame = [r[:4] for r in reads]
    a, b = (rows_of(spark, frame, [("c1", genome)], make) for make in (pileup.pileup, pileup.pileup_by_function))
    assert a == b
    assert all(genome[p - 1] == ref for p, ref, *_ in a)
    assert len(a) == sum(r[5] for r in reads)


def test_pileup_across_reference_windows(spark, monkeypatch):
    rng = random.Random(12)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    frame = [(i, *random_read(rng, genome)[:3]) for i in range(80)]
    whole = rows_of(spark, frame, [("c1", genome)])
    monkeypatch.setattr(pileup, "WINDOW", 7)
    monkeypatch.setattr(pileup.reference_windows, "__defaults__", (7,))
    assert rows_of(spark, frame, [("c1", genome)]) == whole


def test_merge(spark):
    rows = [("c1", 5, "A", 1, ".", "I"), ("c1", 5, "A", 1, ",", "A"), ("c1", 10, "C", 1, "T", "#"), ("c1", 10, "C", 1, "T", '"')]
    merged = merge.merge_pileups(spark.createDataFrame(rows, "chrom string, pos long, ref string, depth int, bases string, quals string"))
    assert sorted(map(tuple, merged.collect())) == [("c1", 5, "A", 2, ",.", "AI"), ("c1", 10, "C", 2, "TT", '"#')]


def test_counts_and_calls(spark):
    bases = [".", ",", "T", "t", "T", "*", ".-1A", ".+2AC"]
    rows = [("c1", 7, "G", 1, b, "I") for b in bases]
    counts = merge.base_counts(spark.createDataFrame(rows, "chrom string, pos long, ref string, depth int, bases string, quals string"))
    r = counts.first()
    assert (r["depth"], r["n_ref"], r["n_g"], r["n_t"], r["n_deleted"], r["n_insertion"], r["n_deletion"]) == (8, 4, 4, 3, 1, 1, 1)
    assert [tuple(x) for x in merge.call_variants(counts).collect()] == [("c1", 7, "G", 8, "T", 3, 375_000)]
    assert merge.call_variants(counts, least_count=4).count() == 0


def test_index_merge_and_correction(spark):
    index = [(0, 1, 2), (0, 2, 1), (0, 3, 3), (1, 1, 1), (1, 4, 2), (2, 2, 4), (2, 1, 3)]
    best = stratum.best_per_read(spark.createDataFrame(index, "fasta_chunk int, read_id long, idx int"))
    assert {r["read_id"]: r["best"] for r in best.collect()} == {1: 1, 2: 1}
    record = spark.createDataFrame([(1, 2, "0:1:2+0:1", "a,b,c")], "read_id long, idx int, summary string, alignments string")
    for given_best, tolerance, want in [(None, 0, "a"), (None, 1, "a,b,c"), (2, 0, "a"), (1, 0, None), (1, 1, "a")]:
        known = spark.createDataFrame([(1, given_best)] if given_best else [], "read_id long, best int")
        got = [r["alignments"] for r in stratum.correct(record, known, tolerance).collect()]
        assert got == ([] if want is None else [want])


def test_greedy_ranges(spark):
    counts = spark.createDataFrame([("c", p, n) for p, n in {1: 5, 2: 4, 3: 1, 4: 5, 5: 9}.items()], "chrom string, pos long, n long")
    tasks = ranges.reducer_tasks(ranges.greedy_ranges(counts, 10))
    assert sorted((r["part"], r["lo"], r["hi"]) for r in tasks.collect()) == [(1, 1, 2), (2, 3, 4), (3, 5, 5)]
    high = spark.createDataFrame([("c", 1, 50), ("c", 2, 1)], "chrom string, pos long, n long")
    assert [r["hi"] for r in ranges.greedy_ranges(high, 10).collect()] == [2]
    assert ranges.greedy_ranges(counts.limit(0), 10).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=30), st.integers(5, 40))
def test_cumulative_ranges_cover(spark, counts, capacity):
    rows = [("c", p, n) for p, n in enumerate(counts, 1)]
    ends = sorted(r["hi"] for r in ranges.cumulative_ranges(spark.createDataFrame(rows, "chrom string, pos long, n long"), capacity, block=4).collect())
    assert ends[-1] == len(counts)
    begin = 0
    for e in ends:
        assert sum(counts[begin:e]) <= capacity + 9
        begin = e


def test_splits(spark):
    pairs = [tuple(r) for r in partition.line_pairs(spark, 40, 3).orderBy("chunk_id").collect()]
    assert pairs == [(0, 1, 17), (1, 17, 33), (2, 33, 41)]
    assert [tuple(r) for r in partition.line_pairs(spark, 8, 5).collect()] == [(0, 1, 5), (1, 5, 9)]
    with pytest.raises(ValueError):
        partition.line_pairs(spark, 41, 3)
    assert [tuple(r)[1:] for r in partition.read_ranges(spark, 10, 3).orderBy("chunk_id").collect()] == [(1, 4), (5, 8), (9, 10)]


def test_line_ranges(spark):
    windows = spark.createDataFrame([(0, 1, 10), (1, 100, 20), (2, 200, 30)], "window long, line_number long, compressed_byte long")
    pairs = spark.createDataFrame([(50, 150), (150, 250)], "line_0 long, line_1 long")
    got = sorted(tuple(r) for r in asof.line_ranges(pairs, windows, 99).collect())
    assert got == [(50, 150, 10, 30), (150, 250, 20, 99)]
    empty = [tuple(r) for r in asof.line_ranges(pairs.limit(1), windows.limit(0), 99).collect()]
    assert empty == [(50, 150, 0, 99)]


def test_as_of_is_spread_and_one_pass(spark):
    rng = random.Random(6)
    at = [rng.randrange(1000) for _ in range(400)] + [None]
    keys = [rng.choice([3, 5, 500, 501, 990, 1200]) for _ in range(300)] + [None]
    left = spark.createDataFrame([(k,) for k in keys], "at long")
    right = spark.createDataFrame([(x, i) for i, x in enumerate(at)], "at long, v long")
    for forward in (False, True):
        found = asof.as_of(left, right, "at", (), ("v",), forward=forward, tie=F.col("v"))
        want = []
        for k in keys:
            near = [(x, i) for i, x in enumerate(at) if None not in (x, k) and (x >= k if forward else x <= k)]
            want.append((k, (min(near) if forward else max(near))[1] if near else None))
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "currentrow$(), unboundedfollowing$()" not in plan  # a frame that is gone through again for each row
        assert "_range" in plan and "Window" in plan


def test_fasta_chunks(spark):
    faidx = spark.createDataFrame([("a", 0, 4), ("b", 30, 36)], "contig string, offset_head long, offset_base long")
    got = [tuple(r) for r in partition.fasta_chunks(faidx, 60, 4).orderBy("chunk_id").collect()]
    assert got == [(0, "a", 0, 4, 14, 0), (1, "a", 0, 15, 29, 11), (2, "b", 30, 36, 44, 0), (3, "b", 30, 45, 59, 9)]


def test_aligner_broadcasts_only_what_is_counted_small(spark, monkeypatch):
    made = spark.range(40).select(F.col("id").alias("read_id"), F.concat_ws("", *(F.translate(F.md5(F.concat(F.lit(str(k)), F.col("id").cast("string"))), "0123456789abcdef", "ACGT" * 4) for k in range(3))).alias("seq"))
    reads = made.select("read_id", F.lit("r").alias("name"), F.substring("seq", 9, 64).alias("seq"), F.lit("I" * 64).alias("qual"))
    contigs = made.select(F.col("read_id").cast("string").alias("contig"), "seq")
    few = kmer.align(reads, contigs)
    monkeypatch.setattr(kmer, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(kmer, "BROADCAST_BASES", 0)
    many = kmer.align(reads, contigs)
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, many.select("read_id", "summary", "alignments").collect()))
    assert got == [(i, "1:0:0:0", f"{i}:+:9:64") for i in range(40)] == sorted(map(tuple, few.select("read_id", "summary", "alignments").collect()))


def test_aligner_finds_places(spark):
    rng = random.Random(4)
    genome = "".join(rng.choice("ACGT") for _ in range(3000))
    other = str.maketrans("ACGT", "TGCA")
    reads = []
    for i in range(30):
        at = rng.randrange(0, 2900)
        seq = list(genome[at : at + 80])
        if i % 3 == 1:
            seq[40] = "A" if seq[40] != "A" else "C"
        text = "".join(seq)
        reads.append((i, f"r{i}", text if i % 2 else text.translate(other)[::-1], "I" * 80, at))
    reads.append((99, "r99", "".join(rng.choice("ACGT") for _ in range(80)), "I" * 80, None))
    frame = spark.createDataFrame([r[:4] for r in reads], "read_id long, name string, seq string, qual string")
    contigs = spark.createDataFrame([("g", genome)], "contig string, seq string")
    got = {r["read_id"]: r for r in kmer.align(frame, contigs, width=512).collect()}
    for i, _, _, _, at in reads[:-1]:
        first = got[i]["alignments"].split(",")[0].split(":")
        assert first[:3] == ["g", "+" if i % 2 else "-", str(at + 1)]
        assert got[i]["summary"].split(":")[1 if i % 3 == 1 else 0] == "1"
    assert got[99]["alignments"] == "-"
    piled = pileup.pileup(kmer.align(frame, contigs), contigs)
    assert piled.where(F.substr(F.lit(genome), F.col("pos").cast("int"), F.lit(1)) != F.col("ref")).count() == 0
