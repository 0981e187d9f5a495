"""DNA strings, FASTA headers and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complement(seq: Column) -> Column:
    """Base by base, not reversed; anything but ACGT in either case stays."""
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def header_name(header: Column) -> Column:
    """First word of a FASTA header, without `>`."""
    return F.regexp_extract(header, r"^>?(\S+)", 1)


def strip_symbols(text: Column) -> Column:
    """Without the characters ._-!/· and ¡."""
    return F.translate(text, "._-!/·¡", "")


def clip_start(text: Column, n: Column) -> Column:
    """Without the first n characters."""
    return F.substr(text, n + 1)


def reference_slice(seq: Column, start: Column, n: Column) -> Column:
    """Upper-cased n bases from a 1-based start; what lies beyond the ends is left out."""
    return F.upper(F.substr(seq, F.greatest(start, F.lit(1)), F.greatest(n + F.least(start - 1, F.lit(0)), F.lit(0))))


def chunk_id(prefix: str, number: Column) -> Column:
    """`fa0007`: a prefix and a number of four digits at least."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), F.greatest(F.length(number.cast("string")), F.lit(4)), F.lit("0")))


def numbers(text: Column) -> Column:
    """All digit runs of a text, as longs."""
    return F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))


def is_accession(text: Column) -> Column:
    """Whether a text looks like a run accession of a public read archive."""
    return text.rlike("^[SED]RR[0-9]+$")
