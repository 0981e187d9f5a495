"""Aligning reads by k-mer seeds: an equi-join of k-mers, then a check of each candidate place without gaps.

This stands in for an external mapper; strata count mismatches (stratum 1: none), and no gaps are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement

#: Seeds and bases that may be broadcast, some 10 MB. Spark's own estimate does not see how long made texts are.
BROADCAST_SEEDS, BROADCAST_BASES = 100_000, 4 << 20


def counted(df: DataFrame, n: int, most: int) -> DataFrame:
    """df, of n units, marked for broadcast up to `most` of them and for a join by shuffle and sort beyond."""
    return F.broadcast(df) if n <= most else df.hint("merge")


def kmers(text: Column, k: int, step: int = 1) -> Column:
    """array<struct<at, kmer>>: substrings of k characters from every `step`-th 0-based place, in UTF-32.

    Characters of one width are found at once; a substring of the text itself would be counted off from its beginning.
    """
    places = lambda b: F.when(F.length(b) >= 4 * k, F.sequence(F.lit(0), (F.length(b) / 4).cast("int") - k, F.lit(step))).otherwise(F.array().cast("array<int>"))
    each = lambda b: F.transform(places(b), lambda i: F.struct(i.alias("at"), F.substring(b, i * 4 + 1, F.lit(4 * k)).alias("kmer")))
    return F.element_at(F.transform(F.array(F.encode(text, "UTF-32")), each), 1)


def upper_ascii(text: str) -> Column:
    """A column in capitals, place by place: the upper case of other characters may be longer and would move what follows."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def reference_windows(contigs: DataFrame, width: int, overlap: int) -> DataFrame:
    """contig, first (0-based), bases: windows of `width` bases and `overlap` more, so that long contigs spread out."""
    # cut from characters of one width, so that no window is counted off from the beginning of its contig
    coded = contigs.select("contig", F.encode(upper_ascii("seq"), "UTF-32").alias("codes")).where(F.length("codes") > 0)
    starts = F.sequence(F.lit(0), (F.length("codes") / 4).cast("int") - 1, F.lit(width))
    bases = F.decode(F.substring(F.col("codes"), F.col("first") * 4 + 1, F.lit(4 * width) + 4 * overlap), "UTF-32")
    return coded.select("contig", "codes", F.explode(starts).alias("first")).select("contig", "first", bases.alias("bases"))


def kmer_index(contigs: DataFrame, k: int = 16, width: int = 65_536) -> DataFrame:
    """kmer, contig, pos (0-based) of every k-mer of contigs(contig, seq).

    Windows are dealt out first: a few bytes of input, or one long contig, may be long work.
    """
    n = int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows = reference_windows(contigs, width, k - 1).repartition(n, "contig", "first")
    return windows.select("contig", "first", F.explode(kmers(F.col("bases"), k)).alias("x")).select(F.decode("x.kmer", "UTF-32").alias("kmer"), "contig", (F.col("first") + F.col("x.at")).alias("pos"))


def seed_hits(reads: DataFrame, index: DataFrame, k: int = 16, step: int = 8) -> DataFrame:
    """read_id, contig, diagonal: places where some seed of a read(read_id, seq) puts its first base."""
    n = reads.agg(F.sum(F.greatest(F.lit(0), F.floor((F.length("seq") - k) / step) + 1))).first()[0] or 0
    seeds = reads.select("read_id", F.explode(kmers(upper_ascii("seq"), k, step)).alias("x")).select("read_id", F.decode("x.kmer", "UTF-32").alias("kmer"), F.col("x.at").alias("at"))
    return counted(seeds, n, BROADCAST_SEEDS).join(index, "kmer").select("read_id", "contig", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()


def mismatches(a: Column, b: Column) -> Column:
    """Number of places where two strings of one length differ."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.aggregate(differ, F.lit(0), lambda n, d: n + d)


def gigar_of(read: Column, reference: Column) -> Column:
    """Runs of matches and, for a mismatch, the reference base."""
    marks = F.array_join(F.zip_with(F.split(read, ""), F.split(reference, ""), lambda x, y: F.when(x == y, "=").otherwise(y)), "")
    parts = F.regexp_extract_all(marks, F.lit("(=+|[A-Z])"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("="), F.length(p).cast("string")).otherwise(p)), "")


def align(reads: DataFrame, contigs: DataFrame, k: int = 16, most: int = 3, step: int = 8, width: int = 65_536, by: tuple[str, ...] = ()) -> DataFrame:
    """reads(read_id, name, seq, qual) -> read_id, name, seq, qual, summary, alignments, by; contigs(contig, seq, by).

    A read has a record for each value of the contigs' columns `by` among its alignments, all found in one pass. Both strands are tried. Candidate places are checked against windows of the reference, joined by contig and window;
    alignments of up to `most` mismatches are listed by stratum, contig, place and strand. A read without any has the
    summary `0:..:0` and alignments `-`, and nulls in `by`. Reads and contigs are counted before any is broadcast.
    """
    contigs = contigs.select(F.struct("contig", *by).alias("contig"), "seq")
    upper = F.upper("seq")
    both = reads.select("read_id", F.explode(F.array(F.struct(F.lit("+").alias("strand"), upper.alias("seq")), F.struct(F.lit("-").alias("strand"), reverse_complement(upper).alias("seq")))).alias("s")).select("read_id", "s.strand", "s.seq")
    keyed = both.withColumn("read_id", F.struct("read_id", "strand"))
    hits = seed_hits(keyed, kmer_index(contigs, k, width), k, step).where("diagonal >= 0")
    n_reads, longest = reads.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("seq")), F.lit(0))).first()
    bases = contigs.agg(F.sum(F.length("seq"))).first()[0] or 0
    windows = reference_windows(contigs, width, longest).withColumn("window", F.col("first") / width)
    placed = hits.withColumn("window", F.floor(F.col("diagonal") / width).cast("double")).join(counted(windows, bases, BROADCAST_BASES), ["contig", "window"])
    placed = placed.join(counted(keyed.select("read_id", "seq"), 2 * n_reads * max(longest, 64), BROADCAST_BASES), "read_id")
    reference = F.substr("bases", (F.col("diagonal") - F.col("first") + 1).cast("int"), F.length("seq"))
    cut = placed.select(F.col("read_id.read_id").alias("read_id"), F.col("read_id.strand").alias("strand"), "contig", "diagonal", "seq", reference.alias("reference")).where(F.length("reference") == F.length("seq"))
    found = cut.withColumn("errors", mismatches(F.col("seq"), F.col("reference"))).where(F.col("errors") <= most)
    # on the reverse strand tokens follow the read: from its last reference base to its first, as their complements
    forward = F.col("strand") == "+"
    gigar = F.when(forward, gigar_of(F.col("seq"), F.col("reference"))).otherwise(gigar_of(reverse_complement(F.col("seq")), reverse_complement(F.col("reference"))))
    text = F.concat_ws(":", "contig.contig", "strand", (F.col("diagonal") + 1).cast("string"), gigar)
    listed = found.groupBy("read_id", *(F.col("contig").getField(c).alias(c) for c in by)).agg(F.array_sort(F.collect_list(F.struct("errors", "contig.contig", "diagonal", "strand", text.alias("text")))).alias("a"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda e: F.size(F.filter("a", lambda x: x["errors"] == e)).cast("string"))
    summed = listed.select("read_id", *by, F.array_join(counts, ":").alias("summary"), F.array_join(F.transform("a", lambda x: x["text"]), ",").alias("alignments"))
    summed = counted(summed, n_reads, BROADCAST_SEEDS // 10)
    return reads.join(summed, "read_id", "left").select("read_id", "name", "seq", "qual", F.coalesce("summary", F.lit(":".join("0" * (most + 1)))).alias("summary"), F.coalesce("alignments", F.lit("-")).alias("alignments"), *by)
