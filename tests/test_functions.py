"""Column functions on the worked cases of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from pilespark.functions import dna, gigar, strata


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(("summary", "idx"), [("1:0:0", 1), ("0:1:2+0:1", 2), ("0:0:10", 3), ("0:0:0+0:1", 0), ("0:0:0", 0)])
def test_best_stratum(spark, summary, idx):
    assert one(spark, strata.best_stratum(F.col("s")), s=summary) == idx


@pytest.mark.parametrize(("threshold", "n", "kept"), [(0, 0, ""), (1, 0, ""), (2, 1, "a"), (3, 3, "a,b,c"), (9, 3, "a,b,c")])
def test_alignments_within(spark, threshold, n, kept):
    assert one(spark, strata.alignments_within(F.col("s"), F.lit(threshold)), s="0:1:2+0:1") == n
    assert one(spark, strata.first_alignments(F.lit("a,b,c"), F.lit(n)), s="") == kept


@pytest.mark.parametrize(("text", "tokens"), [
    ("40A20>5+10(5)", ["40", "A", "20>5+", "10", "(5)"]),
    ("(5)20AC3T>2-7", ["(5)", "20", "A", "C", "3", "T>2-", "7"]),
    ("A(5)", ["A", "(5)"]),
])
def test_tokens(spark, text, tokens):
    assert one(spark, gigar.tokens(F.col("g")), g=text) == tokens


def test_gigar_parts(spark):
    assert one(spark, gigar.has_double_gap(F.col("g")), g="10>5+>7-3")
    parts = [tuple(one(spark, gigar.token_parts(F.col("t")), t=t)) for t in ("40", "a", "(5)", "20>5+", "T>2-")]
    assert parts == [(40, None, 0, 0, None), (1, "a", 0, 0, None), (0, None, 5, 0, None), (20, None, 0, 5, "+"), (1, "T", 0, 2, "-")]
    listed = one(spark, gigar.alignments(F.col("a")), a="c1:+:3:2G2,c2:-:10:5")
    assert [tuple(x) for x in listed] == [("c1", "+", 3, "2G2"), ("c2", "-", 10, "5")]
    assert one(spark, gigar.alignments(F.col("a")), a="-") == []


def test_dna(spark):
    assert one(spark, dna.complement(F.col("s")), s="ACGTNacgtn") == "TGCANtgcan"
    assert one(spark, dna.reverse_complement(F.col("s")), s="AACG") == "CGTT"
    assert one(spark, dna.header_name(F.col("s")), s=">chr1 of a kind") == "chr1"
    assert one(spark, dna.clip_start(F.col("s"), F.lit(2)), s="NNACG") == "ACG"
    assert one(spark, dna.reference_slice(F.col("s"), F.lit(-1), F.lit(4)), s="acgt") == "AC"
    assert one(spark, dna.chunk_id("fa", F.lit(7)), s="") == "fa0007"
    assert one(spark, dna.chunk_id("fa", F.lit(123456)), s="") == "fa123456"
    assert one(spark, dna.numbers(F.col("s")), s="#12: 3 at 45") == [12, 3, 45]
    assert one(spark, dna.strip_symbols(F.col("s")), s="a.b_c-d!e/f·g¡h") == "abcdefgh"
    assert one(spark, dna.is_accession(F.col("s")), s="SRR123") and not one(spark, dna.is_accession(F.col("s")), s="SRR")
