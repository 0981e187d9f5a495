"""Readers, writers, the pipeline and the streaming form."""

import gzip
import json
import random
import zipfile

import pytest

from pilespark.operators import external, merge
from pilespark.pipeline import Params, Pipeline
from pilespark.sources import blocks, fasta, fastq, mapfile, mpileup, runlog, storage
from pilespark.stats import Stats
from pilespark.streaming import pileup as streaming

OBS = "chrom string, pos long, ref string, depth int, bases string, quals string"


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    rng = random.Random(9)
    seqs = {f"chr{k}": "".join(rng.choice("ACGT") for _ in range(900 + 37 * k)) for k in range(3)}
    path = tmp_path_factory.mktemp("g") / "g.fa"
    path.write_text("".join(f">{n} some words\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for n, s in seqs.items()))
    return seqs, str(path)


@pytest.fixture
def blocks_of(spark):
    """Files are read in blocks of so many bytes."""
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_contigs(spark, genome):
    seqs, path = genome
    rows = fasta.read_contigs(spark, path).orderBy("ord").collect()
    assert {r["contig"]: r["seq"] for r in rows} == seqs and rows[0]["description"] == "some words"


@pytest.mark.parametrize("splits", [1, 3, 17])
def test_fasta_lines_and_index(spark, genome, splits, blocks_of):
    seqs, path = genome
    blocks_of(-(-len(open(path, "rb").read()) // splits))
    assert fasta.read_lines(spark, path).rdd.getNumPartitions() >= min(splits, 4)
    lines = fasta.read_lines(spark, path).orderBy("offset").collect()
    for name, seq in seqs.items():
        assert "".join(r["line"] for r in lines if r["contig"] == name) == seq
    data = open(path, "rb").read()
    for r in fasta.faidx(spark, path).collect():
        head = data[r["offset_head"] :]
        assert head.startswith(b">" + r["contig"].encode()) and data[r["offset_base"] - 1 : r["offset_base"]] == b"\n"
        assert data[r["offset_base"] :].startswith(seqs[r["contig"]][:60].encode())


@pytest.mark.parametrize("size", [23, 64, 1 << 20])
def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path, blocks_of, size):
    blocks_of(size)
    texts = {"a.txt": [f"line {i} " + "y" * (i % 37) for i in range(90)], "b.txt": [], "c.txt": ["", "x", ""]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    rows = blocks.numbered_lines(spark, str(tmp_path / "*.txt")).collect()
    for name, lines in texts.items():
        assert sorted((r["line_no"], r["line"]) for r in rows if r["file"].endswith(name)) == list(enumerate(lines, 1))
    both = blocks.zip_lines(blocks.numbered_lines(spark, str(tmp_path / "a.txt")), blocks.numbered_lines(spark, str(tmp_path / "c.txt"))).orderBy("line_no").collect()
    assert [(r["a"], r["b"]) for r in both] == [(a, (texts["c.txt"] + [None] * 90)[i]) for i, a in enumerate(texts["a.txt"])]


def test_fasta_with_carriage_returns_over_files(spark, tmp_path, blocks_of):
    blocks_of(11)
    (tmp_path / "a.fa").write_bytes(b">x one\r\nACGT\r\n\r\nAC\r\n>y\r\nGG\r\n")
    (tmp_path / "b.fa").write_bytes(b"TT\n>z\nCCCCCCCCCCCCCCCCCCCCCCCC\nA")
    lines = fasta.read_lines(spark, str(tmp_path / "*.fa")).collect()
    assert sorted((r["file"][-4:], r["contig"], r["offset"], r["line"]) for r in lines if r["contig"]) == [("a.fa", "x", 8, "ACGT"), ("a.fa", "x", 16, "AC"), ("a.fa", "y", 24, "GG"), ("b.fa", "z", 6, "C" * 24), ("b.fa", "z", 31, "A")]
    assert [r["line"] for r in lines if not r["contig"]] == ["TT"]
    assert sorted((r["contig"], r["offset_head"], r["offset_base"]) for r in fasta.faidx(spark, str(tmp_path / "*.fa")).collect()) == [("x", 0, 8), ("y", 20, 24), ("z", 3, 6)]


def test_fasta_round_trip(spark, genome, tmp_path):
    fasta.write_fasta(fasta.read_contigs(spark, genome[1]).coalesce(1), str(tmp_path / "out"))
    assert {r["contig"]: r["seq"] for r in fasta.read_contigs(spark, str(tmp_path / "out" / "part*")).collect()} == genome[0]


def test_fastq(spark, tmp_path, blocks_of):
    text = "".join(f"@r{i} x\nACGT\n+\nII\"{chr(35 + i)}\n" for i in range(9))
    (tmp_path / "a.fq").write_text(text)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(text)
    rows = fastq.read_fastq(spark, str(tmp_path / "*.fq*")).collect()
    assert len(rows) == 18 and {r["name"] for r in rows} == {f"r{i}" for i in range(9)}
    part = fastq.read_fastq(spark, str(tmp_path / "b.fq.gz"), 3, 5).orderBy("read_no").collect()
    assert [(r["read_no"], r["qual"]) for r in part] == [(3, 'II"%'), (4, 'II"&'), (5, "II\"'")]
    blocks_of(31)
    whole = fastq.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("read_no").collect()
    assert [(r["read_no"], r["name"], r["qual"]) for r in whole] == [(i + 1, f"r{i}", f'II"{chr(35 + i)}') for i in range(9)]
    (tmp_path / "bad.fq").write_text("@r\nACGT\n+\nI\n")
    with pytest.raises(Exception, match="not FASTQ"):
        fastq.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_gzip_windows(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(40_000)]
    path = str(tmp_path / "t.gz")
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines) + "\n")
    rows = fastq.window_table(spark, path, 1 << 17).orderBy("window").collect()
    data = ("\n".join(lines) + "\n").encode()
    assert len(rows) > 2
    for r in rows:
        assert r["line_number"] == data[: r["uncompressed_byte"]].count(b"\n") + 1
    listing = spark.createDataFrame([("#1: @ 10 / 0 L1 ( 32768 @20 )",), ("no numbers",)], "value string")
    assert [tuple(r) for r in fastq.parse_listing(listing).collect()] == [(1, 10, 0, 1, 32768, 20)]
    assert fastq.run_spots(spark, "<S><RUN total_spots='77'/><RUN total_spots='1'/></S>").first()[0] == 77


def test_map_lines(spark, tmp_path):
    (tmp_path / "x.map").write_text("read 1\tACGT\tII#\"\t1:0\tc:+:1:4\nshort\tline\n")
    assert [tuple(r) for r in mapfile.read_map(spark, str(tmp_path / "x.map")).collect()] == [("read 1", "ACGT", 'II#"', "1:0", "c:+:1:4")]
    with zipfile.ZipFile(tmp_path / "x.bz2", "w", zipfile.ZIP_BZIP2) as z:
        z.writestr("m", "a\tb\nc\td\n")
    assert sorted(r["value"] for r in mapfile.read_zipped(spark, str(tmp_path / "x.bz2")).collect()) == ["a\tb", "c\td"]


def test_pileup_round_trips(spark, tmp_path):
    rows = [("c1", 10, "C", 2, "TT", '"\\'), ("c1", 9, "A", 1, ".+2AC", "#"), ("c2", 1, "A", 1, "*", "*")]
    df = spark.createDataFrame(rows, mpileup.SCHEMA)
    mpileup.write_pileups(df, str(tmp_path / "p"))
    back = mpileup.read_pileups(spark, str(tmp_path / "p"))
    assert sorted(tuple(r[c] for c in ("chrom", "pos", "ref", "depth", "bases", "quals")) for r in back.collect()) == sorted(rows)
    plan = merge.scan_range(back, 5, 9)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(pos,5)" in plan
    mpileup.write_text(df, str(tmp_path / "t"), single_file=True)
    assert [tuple(r) for r in mpileup.read_text(spark, str(tmp_path / "t")).collect()] == [rows[1], rows[0], rows[2]]


def test_run_logs(spark, tmp_path):
    log = {"pipeline": {"map": {"align": {"phases": {"s1": {"function_details": [{"f1": {"timestamps": {"start": 1.5, "end": 2.5}, "data_sizes": {"in": 10.0}, "execution_time": 1.0}}]}}}}}}
    (tmp_path / "log.json").write_text(json.dumps(log))
    r = runlog.read_legacy(spark, str(tmp_path / "log.json")).first()
    assert (r["phase"], r["step"], r["stage"], r["fn"], r["execution_time"]) == ("map", "align", "s1", "f1", 1.0)
    assert [tuple(x) for x in r["data_sizes"]] == [("in", 10.0)]
    stats = Stats()
    with stats.timed("a"):
        stats.add("n", 2)
    stats.store(spark, str(tmp_path / "stats"))
    assert runlog.read_stats(spark, str(tmp_path / "stats")).first()["timer"] == "a"


def test_storage(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("xyz")
    assert storage.exists(spark, str(tmp_path / "d"))
    assert [(r["path"].rpartition("/")[2], r["length"]) for r in storage.listing(spark, str(tmp_path), "*.txt").collect()] == [("a.txt", 3)]
    storage.remove(spark, str(tmp_path / "d"), str(tmp_path / "none"))
    assert not storage.exists(spark, str(tmp_path / "d"))
    assert storage.split_uri("s3://bucket/a/./b/../c.txt") == ("s3", "bucket", "a/c.txt")
    assert storage.split_uri("s3://bucket/../x") == ("s3", "bucket", "x")
    with pytest.raises(ValueError):
        storage.split_uri("/local/path")
    assert storage.stage_prefix("7", "map") == "run-7.tmp/map"


def test_pipe(spark):
    lines = spark.createDataFrame([("b",), ("a",)], "value string").coalesce(1)
    assert [r[0] for r in external.pipe(lines, ["sort"]).collect()] == ["a", "b"]


def test_pipeline_calls_planted_variants(spark, genome, tmp_path):
    seqs, path = genome
    rng = random.Random(3)
    other = str.maketrans("ACGT", "TGCA")
    changed = {n: list(s) for n, s in seqs.items()}
    planted = {}
    for name in seqs:
        for pos in (200, 500, 800):
            ref = seqs[name][pos - 1]
            changed[name][pos - 1] = planted[name, pos] = next(c for c in "ACGT" if c != ref)
    with open(tmp_path / "r.fq", "w") as f:
        for i in range(900):
            name = rng.choice(list(seqs))
            at = rng.randrange(0, len(seqs[name]) - 70)
            read = "".join(changed[name][at : at + 70])
            read = read if i % 2 else read.translate(other)[::-1]
            f.write(f"@r{i}\n{read}\n+\n{'I' * 70}\n")
    params = Params(path, str(tmp_path / "r.fq"), str(tmp_path / "out"), fasta_chunks=2, run_id="run")
    pipeline = Pipeline(spark, params)
    got = {(r["chrom"], r["pos"]): r["alt"] for r in pipeline.run().collect()}
    assert got == planted
    again = Pipeline(spark, params)
    assert again.run().count() == len(planted) and again.stats().count() == 0
    assert again.tasks().count() == 3
    again.clean_temporary()
    assert again.exists(again.path("variants")) and not again.exists(again.path("map"))
    again.clean()
    assert not again.exists(again.path("variants"))


def test_parameters_are_checked(spark):
    with pytest.raises(ValueError):
        Pipeline(spark, fasta_path="", fastq_path="b", output_path="c")
    with pytest.raises(ValueError):
        Pipeline(spark, fasta_path="a", fastq_path="b", output_path="c", accession="nothing")


def test_streaming_counts(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("c", 5, "A", 1, "." if k else "T", "I"), ("c", 6 + k, "C", 1, ",", "I")], OBS).write.parquet(str(tmp_path / "in" / f"k{k}"))
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = streaming.start_counts(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    run.processAllAvailable()
    run.stop()
    rows = spark.read.parquet(str(tmp_path / "out")).where("pos = 5").orderBy("depth").collect()
    assert rows[-1]["depth"] == 3 and rows[-1]["n_t"] == 1
