"""Expanding alignments into one base observation for each reference position.

Reads have read_id, seq, qual and alignments; observations chrom, pos, ref, depth, bases, quals. Bases are `.` (match,
forward) or `,` (match, reverse), a letter (mismatch, lower case if reverse) or `*` (deleted), with `+n...` after the last
base before an insertion and `-n...` before a deletion.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import clip_start, complement
from ..functions.gigar import alignments, has_double_gap, token_parts, tokens

#: Bases of a reference window that deletions look their bases up in.
WINDOW = 65_536


def explode_alignments(records: DataFrame) -> DataFrame:
    """read_id, seq, qual, aln, chrom, strand, start, gigar: all listed alignments but those with two gaps in a row."""
    each = records.select("read_id", "seq", "qual", F.posexplode(alignments(F.col("alignments"))).alias("aln", "a"))
    return each.select("read_id", "seq", "qual", "aln", "a.*").where(~has_double_gap(F.col("gigar")))


def reference_windows(contigs: DataFrame, width: int = WINDOW) -> DataFrame:
    """contigs(contig, seq) -> chrom, window, bases: slices of `width` bases, numbered from 0.

    Sequences are ASCII, so slices are cut from their bytes: a slice of text would be counted off from the beginning.
    """
    starts = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / width))
    return contigs.where(F.length("seq") > 0).select(F.col("contig").alias("chrom"), "seq", F.explode(starts).alias("window")).select("chrom", "window", F.upper(F.substring(F.col("seq").cast("binary"), (F.col("window") * width + 1).cast("int"), F.lit(width)).cast("string")).alias("bases"))


def placed_tokens(aligned: DataFrame) -> DataFrame:
    """Tokens of each alignment with what lies before them: bases taken (b), deleted (d) and inserted (i).

    The sums run inside each alignment's token array, so no shuffle is needed. seq and qual come clipped, and
    complemented on the reverse strand; span is the reference span, from which reverse positions count down.
    """
    parts = aligned.withColumn("tokens", F.transform(tokens(F.col("gigar")), token_parts))
    total = lambda pick: F.aggregate("tokens", F.lit(0), lambda n, t: n + pick(t))
    gap = lambda op: lambda t: F.when(t["op"] == op, t["gap"]).otherwise(0)
    lead = F.coalesce(F.get("tokens", F.lit(0))["clip"], F.lit(0))
    parts = parts.withColumns({"lead": lead, "span": F.length("seq") + total(gap("+")) - total(lambda t: t["clip"]) - total(gap("-"))})
    parts = parts.withColumns({"seq": clip_start(F.when(F.col("strand") == "-", complement(F.col("seq"))).otherwise(F.col("seq")), F.col("lead")), "qual": clip_start(F.col("qual"), F.col("lead"))})
    sums = F.struct(F.lit(0).alias("b"), F.lit(0).alias("d"), F.lit(0).alias("i"))
    grow = lambda s, t: F.struct((s["b"] + t["bases"]).alias("b"), (s["d"] + gap("+")(t)).alias("d"), (s["i"] + gap("-")(t)).alias("i"))
    placed = lambda t, k: F.struct(t.alias("t"), F.aggregate(F.slice("tokens", F.lit(1), k), sums, grow).alias("s"))
    return parts.withColumn("p", F.explode(F.transform("tokens", placed))).select("read_id", "aln", "chrom", "strand", "start", "span", "seq", "qual", "p.t.*", "p.s.*").where("bases > 0")


def pileup(records: DataFrame, contigs: DataFrame) -> DataFrame:
    """Observations of all alignments of records, one row each, with read_id and aln; contigs(contig, seq).

    Reference bases are read off the read itself but for deletions, whose bases are looked up by an equi-join of only
    the deleted positions with windows of the contigs; the contigs are never gathered on a task or broadcast.
    """
    token = placed_tokens(explode_alignments(records)).withColumn("forward", F.col("strand") != "-")
    base = token.withColumn("m", F.explode(F.sequence(F.lit(1), F.col("bases"))))
    base = base.withColumns({
        "pos": F.when(F.col("forward"), F.col("start") + F.col("b") + F.col("m") - 1 + F.col("d")).otherwise(F.col("start") + F.col("span") - F.col("b") - F.col("m") - F.col("d")),
        "at": F.col("b") + F.col("m") + F.col("i"),
    })
    read_base = F.substr("seq", F.col("at"), F.lit(1))
    letter = F.upper(F.when(F.col("forward"), F.col("letter")).otherwise(complement(F.col("letter"))))
    last = (F.col("m") == F.col("bases")) & F.col("letter").isNull() & (F.col("gap") > 0)
    inserted = F.concat(F.lit("+"), F.col("gap").cast("string"), F.upper(F.substr("seq", F.col("at") + 1, F.col("gap"))))
    shown = F.when(F.col("letter").isNotNull(), F.when(F.col("forward"), read_base).otherwise(F.lower(read_base))).otherwise(F.when(F.col("forward"), ".").otherwise(","))
    rows = base.select("read_id", "aln", "chrom", "pos", F.when(F.col("letter").isNull(), F.upper(read_base)).otherwise(letter).alias("ref"), F.concat(shown, F.when(last & (F.col("op") == "-"), inserted).otherwise(F.lit(""))).alias("bases"), F.substr("qual", F.col("at"), F.lit(1)).alias("quals"), F.when(last & (F.col("op") == "+"), F.col("gap")).alias("gap"), "b")
    # the position of the last base before a deletion, and the deleted positions after it (reverse: below it)
    deleting = token.where("op = '+'").withColumn("edge", F.when(F.col("forward"), F.col("start") + F.col("b") + F.col("bases") - 1 + F.col("d")).otherwise(F.col("start") + F.col("span") - F.col("b") - F.col("bases") - F.col("d")))
    gone = deleting.select("read_id", "aln", "chrom", "b", "gap", F.explode(F.sequence(F.lit(1), F.col("gap"))).alias("k"), "forward", "edge").withColumn("pos", F.when(F.col("forward"), F.col("edge") + F.col("k")).otherwise(F.col("edge") - F.col("k")))
    looked = gone.withColumn("window", F.floor((F.col("pos") - 1) / WINDOW)).join(reference_windows(contigs), ["chrom", "window"]).withColumn("ref", F.substr("bases", (F.col("pos") - F.col("window") * WINDOW).cast("int"), F.lit(1))).where("ref <> ''")
    deleted = looked.select("read_id", "aln", "chrom", "pos", "ref", F.lit("*").alias("bases"), F.lit("*").alias("quals"))
    texts = looked.groupBy("read_id", "aln", "b").agg(F.expr("listagg(ref, '') within group (order by pos)").alias("text"))
    plain = rows.where("gap is null")
    before = rows.where("gap is not null").join(texts, ["read_id", "aln", "b"], "left").withColumn("bases", F.concat("bases", F.lit("-"), F.col("gap").cast("string"), F.coalesce("text", F.lit(""))))
    columns = ["read_id", "aln", "chrom", "pos", "ref", "bases", "quals"]
    every = plain.select(columns).union(before.select(columns)).union(deleted.select(columns))
    return every.select("read_id", "aln", "chrom", F.col("pos").cast("long").alias("pos"), "ref", F.lit(1).alias("depth"), "bases", "quals")


def observe(seq: str, qual: str, strand: str, start: int, gigar: str, contig: str) -> Iterator[tuple[int, str, str, str]]:
    """(pos, ref, bases, quals) of one alignment, base by base: the plain form that pileup() is tested against."""
    import re

    if re.search(r">[0-9]+[+-]>[0-9]+[+-]", gigar):
        return
    found = re.findall(r"([0-9]+>[0-9]+[+-]|[A-Za-z]>[0-9]+[+-]|[(][0-9]+[)]|[0-9]+|[A-Za-z])", gigar)
    other = str.maketrans("ACGTacgt", "TGCAtgca")
    gaps = [re.search(r">([0-9]+)([+-])", t) for t in found]
    clips = [int(t[1:-1]) if t[0] == "(" else 0 for t in found]
    size = lambda op: sum(int(g[1]) for g in gaps if g and g[2] == op)
    span = len(seq) + size("+") - sum(clips) - size("-")
    forward = strand != "-"
    if not forward:
        seq = seq.translate(other)
    lead = clips[0] if clips else 0
    seq, qual = seq[lead:], qual[lead:]
    at, step = 0, 0  # next base of the read, bases of the reference done
    place = lambda: start + step if forward else start + span - 1 - step
    for t, g, clip in zip(found, gaps, clips, strict=True):
        if clip or t[0] == "(":
            continue
        letter = t[0] if t[0].isalpha() else None
        n = 1 if letter else int(re.match("[0-9]+", t)[0])
        for m in range(n):
            here = seq[at : at + 1]
            if letter:
                ref, shown = (letter.upper(), here) if forward else (letter.translate(other).upper(), here.lower())
            else:
                ref, shown = here.upper(), "." if forward else ","
            if g and not letter and m == n - 1:
                k = int(g[1])
                if g[2] == "-":
                    shown += f"+{k}{seq[at + 1 : at + 1 + k].upper()}"
                else:
                    p = place()
                    shown += f"-{k}{(contig[p : p + k] if forward else contig[max(0, p - 1 - k) : p - 1]).upper()}"
            yield place(), ref, shown, qual[at : at + 1]
            at, step = at + 1, step + 1
        if g and g[2] == "+":
            for _ in range(int(g[1])):
                if 0 < place() <= len(contig):
                    yield place(), contig[place() - 1].upper(), "*", "*"
                step += 1
        elif g:
            at += int(g[1])


def pileup_by_function(records: DataFrame, contigs: DataFrame) -> DataFrame:
    """The same observations by a Python table function, an alignment at a time; for small references and cross-checks."""
    aligned = explode_alignments(records).join(contigs.select(F.col("contig").alias("chrom"), F.col("seq").alias("contig_seq")), "chrom")

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(r.read_id, r.aln, r.chrom, *x) for r in batch.itertuples() for x in observe(r.seq, r.qual, r.strand, r.start, r.gigar, r.contig_seq)]
            yield pd.DataFrame(rows, columns=["read_id", "aln", "chrom", "pos", "ref", "bases", "quals"])

    made = aligned.mapInPandas(run, "read_id long, aln int, chrom string, pos long, ref string, bases string, quals string")
    return made.select("read_id", "aln", "chrom", "pos", "ref", F.lit(1).alias("depth"), "bases", "quals")
