"""Alignments as text: `chrom:strand:start:gigar`, the last part being a chain of tokens.

Tokens are a run of matches (`40`), a mismatch that names the reference base (`A`), a soft clip (`(5)`), and a run or
mismatch followed by a gap: `>n+` (n reference bases missing in the read) or `>n-` (n bases inserted in the read).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([0-9]+>[0-9]+[+-]|[A-Za-z]>[0-9]+[+-]|[(][0-9]+[)]|[0-9]+|[A-Za-z])"
#: Two gaps in a row: such alignments are left out.
DOUBLE_GAP = r">[0-9]+[+-]>[0-9]+[+-]"


def tokens(gigar: Column) -> Column:
    return F.regexp_extract_all(gigar, F.lit(TOKEN), F.lit(1))


def has_double_gap(gigar: Column) -> Column:
    return gigar.rlike(DOUBLE_GAP)


def token_parts(token: Column) -> Column:
    """struct(bases, letter, clip, gap, op): bases of the read that a token takes up, and its gap if it has one."""
    number = lambda pattern: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(token, pattern, 1), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(0))
    letter = F.nullif(F.regexp_extract(token, "^([A-Za-z])", 1), F.lit(""))
    return F.struct(
        F.when(letter.isNotNull(), 1).otherwise(number("^([0-9]+)")).alias("bases"),
        letter.alias("letter"),
        number("^[(]([0-9]+)[)]").alias("clip"),
        number(">([0-9]+)[+-]").alias("gap"),
        F.nullif(F.regexp_extract(token, ">[0-9]+([+-])", 1), F.lit("")).alias("op"),
    )


def alignments(text: Column) -> Column:
    """array<struct<chrom, strand, start, gigar>> of a comma-separated list; `-` (unmapped) gives an empty array."""
    parts = lambda a: F.split(a, ":")
    one = lambda a: F.struct(F.get(parts(a), F.lit(0)).alias("chrom"), F.get(parts(a), F.lit(1)).alias("strand"), F.get(parts(a), F.lit(2)).cast("long").alias("start"), F.get(parts(a), F.lit(3)).alias("gigar"))
    return F.transform(F.filter(F.split(text, ","), lambda a: (a != "-") & (a != "")), one)


def reference_span(read_length: Column, gigar: Column) -> Column:
    """Reference bases that a read of some length covers: deletions add, insertions and clips take away."""
    total = lambda pattern: F.aggregate(F.regexp_extract_all(gigar, F.lit(pattern), F.lit(1)), F.lit(0), lambda n, x: n + x.cast("int"))
    return read_length + total(">([0-9]+)[+]") - total(">([0-9]+)[-]") - total("[(]([0-9]+)[)]")
