"""One query for each operator over the test tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna, gigar, strata
from ..operators import asof, external, kmer, merge, partition, pileup, ranges, runs, stratum
from ..sources import blocks, fasta, fastq, mapfile, mpileup, storage
from .lenses import LENSES, lens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOLERANCE, WIDTH, CAPACITY = 1, 100, 2_000


def query(sql: str | None):
    """Register a function as a query, with its SQL; {name} in the SQL stands for a lens."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            text = sql
            for name, body in LENSES.items():
                text = text.replace("{" + name + "}", f"({body.replace('string', 'varchar')}) as {name}")
            ORACLE[f.__name__] = text
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MERGED = """
    select chrom, pos, ref, cast(sum(depth) as bigint) as depth, string_agg(bases, '' order by bases, quals) as bases, string_agg(quals, '' order by bases, quals) as quals
    from {obs} group by chrom, pos, ref"""


@query(MERGED)
def pileup_merge(spark, sf_dir):
    return merge.merge_pileups(lens(spark, sf_dir, "obs"))


@query(MERGED)
def pileup_merge_two_level(spark, sf_dir):
    """Each observation as a partial pileup of its own part, then merged: the same rows as at one level."""
    obs = lens(spark, sf_dir, "obs")
    parts = [merge.scan_range(obs.where(F.col("line_no") % 2 == k), 0, 1 << 40) for k in (0, 1)]
    return merge.merge_pileups(merge.union_parts(*parts))


@query("select chrom, pos, ref, depth, bases, quals from {obs} where pos between 100 and 199")
def range_scan(spark, sf_dir):
    return merge.scan_range(lens(spark, sf_dir, "obs"), 100, 199).select("chrom", "pos", "ref", "depth", "bases", "quals")


@query("select chrom, pos, depth, bases from {obs}")
def union_parts(spark, sf_dir):
    """Two parts that make the whole."""
    obs = lens(spark, sf_dir, "obs")
    pick = lambda c: obs.where(c).select("chrom", "pos", "depth", "bases")
    return merge.union_parts(pick("line_no <= 2"), pick("line_no > 2"))


COUNTS = """
    select chrom, pos, ref, count(*) as depth, count(*) filter (bases in ('.', ',')) as n_ref,
           count(*) filter (b = 'A') as n_a, count(*) filter (b = 'C') as n_c, count(*) filter (b = 'G') as n_g, count(*) filter (b = 'T') as n_t,
           cast(0 as bigint) as n_deleted, cast(0 as bigint) as n_insertion, cast(0 as bigint) as n_deletion
    from (select *, case when bases in ('.', ',') then ref else bases end as b from {obs}) x group by chrom, pos, ref"""


@query(COUNTS)
def base_counts(spark, sf_dir):
    return merge.base_counts(lens(spark, sf_dir, "obs"))


@query(f"""
    with c as ({COUNTS}),
    o as (select chrom, pos, ref, depth, unnest([struct_pack(n := n_a, alt := 'A'), struct_pack(n := n_c, alt := 'C'), struct_pack(n := n_g, alt := 'G'), struct_pack(n := n_t, alt := 'T')]) as x from c),
    r as (select chrom, pos, ref, depth, x.alt as alt, x.n as alt_count, x.n * 1000000 // depth as freq_ppm from o where x.alt <> ref
          qualify row_number() over (partition by chrom, pos, ref order by x.n desc, x.alt) = 1)
    select * from r where depth >= 4 and alt_count >= 2 and freq_ppm >= 200000""")
def call_variants(spark, sf_dir):
    return merge.call_variants(merge.base_counts(lens(spark, sf_dir, "obs")))


@query("select chrom, pos, bases, quals, times from (select *, count(*) over (partition by chrom, pos) as times from {obs}) x where times > 1")
def dup_positions(spark, sf_dir):
    return merge.duplicate_positions(lens(spark, sf_dir, "obs")).select("chrom", "pos", "bases", "quals", "times")


@query("select pos, count(*) as n from {obs} group by pos")
def pos_histogram(spark, sf_dir):
    return ranges.position_histogram(lens(spark, sf_dir, "obs"))


@query(f"""
    with o as (select chrom, pos from {{obs}}), t as (select chrom, max(pos) as top from o group by chrom),
    b as (select chrom, unnest(range(1, cast(ceil(top / {WIDTH}.0) as bigint) + 1)) as bin, top from t),
    n as (select chrom, cast(ceil(pos / {WIDTH}.0) as bigint) as bin, count(*) as n from o group by 1, 2)
    select b.chrom, cast(least(b.bin * {WIDTH}, top) as bigint) as upper, coalesce(n.n, 0) as n from b left join n on b.chrom = n.chrom and b.bin = n.bin""")
def binned_histogram(spark, sf_dir):
    return ranges.binned_histogram(lens(spark, sf_dir, "obs"), WIDTH, "chrom")


GREEDY = f"""
    with recursive h as (select chrom, pos, count(*) as n from {{obs}} group by chrom, pos),
    o as (select *, row_number() over (partition by chrom order by pos) as i from h),
    s(chrom, i, pos, total, hi) as (
        select chrom, i, pos, case when n < {CAPACITY} then n else 0 end, cast(null as bigint) from o where i = 1
        union all
        select o.chrom, o.i, o.pos, case when s.total + o.n < {CAPACITY} then s.total + o.n else 0 end, case when s.total + o.n < {CAPACITY} then null else s.pos end
        from s join o on o.chrom = s.chrom and o.i = s.i + 1),
    g as (select chrom, hi from s where hi is not null union all select chrom, max(pos) from h group by chrom)
"""


@query(GREEDY + "select chrom, cast(hi as bigint) as hi from g")
def greedy_ranges(spark, sf_dir):
    return ranges.greedy_ranges(ranges.position_histogram(lens(spark, sf_dir, "obs"), "chrom"), CAPACITY)


@query(GREEDY + "select chrom, cast(row_number() over w as int) as part, cast(lag(hi, 1, 0) over w + 1 as bigint) as lo, cast(hi as bigint) as hi from g window w as (partition by chrom order by hi)")
def reducer_tasks(spark, sf_dir):
    return ranges.reducer_tasks(ranges.greedy_ranges(ranges.position_histogram(lens(spark, sf_dir, "obs"), "chrom"), CAPACITY))


@query(f"""
    with h as (select chrom, pos, count(*) as n from {{obs}} group by chrom, pos),
    r as (select chrom, pos, (sum(n) over (partition by chrom order by pos) - 1) // {CAPACITY} as part from h)
    select chrom, cast(max(pos) as bigint) as hi from r group by chrom, part""")
def cumulative_ranges(spark, sf_dir):
    return ranges.cumulative_ranges(ranges.position_histogram(lens(spark, sf_dir, "obs"), "chrom"), CAPACITY, block=64)


BEST = "select read_id, cast(min(idx) as int) as best, count(*) as n_chunks from {idx} group by read_id having count(*) >= 2"


@query(BEST)
def best_stratum(spark, sf_dir):
    return stratum.best_per_read(lens(spark, sf_dir, "idx"))


@query("""
    with i as (select * from {idx})
    select coalesce(a.read_id, b.read_id) as read_id, cast(least(a.idx, b.idx) as int) as best, a.idx is not null and b.idx is not null as in_both
    from (select * from i where fasta_chunk = 0) a full join (select * from i where fasta_chunk = 1) b on a.read_id = b.read_id""")
def outer_merge(spark, sf_dir):
    idx = lens(spark, sf_dir, "idx")
    return stratum.merge_indexes(idx.where("fasta_chunk = 0"), idx.where("fasta_chunk = 1"))


SPLIT = "list_transform(string_split(string_split(summary, '+')[1], ':'), lambda x: cast(x as int))"
FIRST = f"coalesce(list_position(list_transform({SPLIT}, lambda n: n > 0), true), 0)"
INDEXED = f"select *, cast({FIRST} as int) as idx from {{maps}} where alignments <> '-' and regexp_matches(string_split(summary, '+')[1], '[1-9]')"


@query(f"select read_id, fasta_chunk, line_no, cast({FIRST} as int) as idx from {{maps}}")
def first_stratum(spark, sf_dir):
    return lens(spark, sf_dir, "maps").select("read_id", "fasta_chunk", "line_no", strata.best_stratum(F.col("summary")).alias("idx"))


@query(f"select read_id, fasta_chunk, line_no, idx, alignments from ({INDEXED}) x")
def index_reads(spark, sf_dir):
    return stratum.index_reads(lens(spark, sf_dir, "maps")).select("read_id", "fasta_chunk", "line_no", "idx", "alignments")


@query(f"""
    with x as (select *, cast(least(line_no, 3) as int) as k, {SPLIT} as s from {{maps}})
    select read_id, line_no, cast(coalesce(list_sum(s[1:k]), 0) as int) as n_alignments, array_to_string(string_split(alignments, ',')[1:cast(coalesce(list_sum(s[1:k]), 0) as int)], ',') as alignments from x""")
def prefix_trim(spark, sf_dir):
    n = strata.alignments_within(F.col("summary"), F.least("line_no", F.lit(3)))
    return lens(spark, sf_dir, "maps").select("read_id", "line_no", n.alias("n_alignments"), strata.first_alignments(F.col("alignments"), n).alias("alignments"))


CORRECTED = f"""
    with i as ({INDEXED}), b as (select read_id, min(idx) as best from (select read_id, fasta_chunk, min(idx) as idx from i group by 1, 2) y group by 1 having count(*) >= 2),
    j as (select i.*, b.best, coalesce(b.best, i.idx) + {TOLERANCE} as threshold from i left join b on i.read_id = b.read_id)"""


def indexed(spark, sf_dir):
    index = stratum.index_reads(lens(spark, sf_dir, "maps"))
    return index, stratum.best_per_read(index.groupBy("read_id", "fasta_chunk").agg(F.min("idx").alias("idx")))


@query(CORRECTED + f"""
    select read_id, fasta_chunk, line_no, idx, cast(threshold as int) as threshold, cast(list_sum({SPLIT}[1:threshold]) as int) as n_alignments,
           array_to_string(string_split(alignments, ',')[1:cast(list_sum({SPLIT}[1:threshold]) as int)], ',') as alignments
    from j where best is null or idx <= best + {TOLERANCE}""")
def index_correct(spark, sf_dir):
    return stratum.correct(*indexed(spark, sf_dir), TOLERANCE).select("read_id", "fasta_chunk", "line_no", "idx", "threshold", "n_alignments", "alignments")


@query("""
    select fasta_chunk, count(*) as n_total, count(*) filter (alignments = '-') as n_no_match,
           count(*) filter (alignments <> '-' and not regexp_matches(string_split(summary, '+')[1], '[1-9]')) as n_unlikely,
           count(*) filter (alignments <> '-' and regexp_matches(string_split(summary, '+')[1], '[1-9]')) as n_kept
    from {maps} group by fasta_chunk""")
def qc_counters(spark, sf_dir):
    return stratum.quality_counters(lens(spark, sf_dir, "maps"), "fasta_chunk")


@query(CORRECTED + f"""
    select count(*) as n_total, count(*) filter (best is null) as n_single, count(*) filter (idx = best) as n_best,
           count(*) filter (idx > best and idx <= best + {TOLERANCE}) as n_tolerated, count(*) filter (idx > best + {TOLERANCE}) as n_discarded,
           count(*) - count(*) filter (idx > best + {TOLERANCE}) as n_filtered, count(*) filter (idx > best + {TOLERANCE}) * 1000000 // count(*) as discarded_ppm
    from j""")
def correction_counters(spark, sf_dir):
    return stratum.correction_counters(*indexed(spark, sf_dir), TOLERANCE)


TOKEN = r"([0-9]+>[0-9]+[+-]|[A-Za-z]>[0-9]+[+-]|[(][0-9]+[)]|[0-9]+|[A-Za-z])"


@query(f"select read_id, strand, start, array_to_string(regexp_extract_all(gigar, '{TOKEN}', 1), ' ') as tokens from {{gigars}}")
def gigar_tokens(spark, sf_dir):
    return lens(spark, sf_dir, "gigars").select("read_id", "strand", "start", F.array_join(gigar.tokens(F.col("gigar")), " ").alias("tokens"))


def listed(pattern: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all(gigar, '{pattern}', 1), lambda x: cast(x as int))), 0)"


@query(f"select read_id, cast(12 + {listed('>([0-9]+)[+]')} - {listed('>([0-9]+)[-]')} - {listed('[(]([0-9]+)[)]')} as int) as span from {{gigars}}")
def read_spans(spark, sf_dir):
    return lens(spark, sf_dir, "gigars").select("read_id", gigar.reference_span(F.lit(12), F.col("gigar")).alias("span"))


@query("select chrom, pos, cast(dense_rank() over (partition by chrom order by pos) as int) as place, count(*) as depth from {obs} group by chrom, pos")
def ordered_positions(spark, sf_dir):
    """Positions in order within each contig."""
    histogram = ranges.position_histogram(lens(spark, sf_dir, "obs"), "chrom").withColumnRenamed("n", "depth")
    return histogram.select("chrom", "pos", F.dense_rank().over(Window.partitionBy("chrom").orderBy("pos")).alias("place"), "depth")


@query("select n_regionkey as contig, n_nationkey as split, lag(n_name) over (order by n_nationkey) as carried from nation")
def carried_header(spark, sf_dir):
    """What each split takes over from the one before it."""
    splits = table(spark, sf_dir, "nation")  # one row for each split
    return splits.select(F.col("n_regionkey").alias("contig"), F.col("n_nationkey").alias("split"), F.lag("n_name").over(Window.orderBy("n_nationkey")).alias("carried"))


@query("select count(*) as n_sequences, count(distinct n_regionkey) as n_files from nation")
def sequence_count(spark, sf_dir):
    return table(spark, sf_dir, "nation").agg(F.count(F.lit(1)).alias("n_sequences"), F.count_distinct("n_regionkey").alias("n_files"))


#: Reads of 12 bases on a reference of 200, by the same rules as pileup() but laid out for SQL.
SEQ, QUAL, REFERENCE = "ACGTACGTACGT", "ABCDEFGHIJKL", "ACGT" * 50
OBSERVED = f"""
    with r as (select *, '{SEQ}' as seq0, '{QUAL}' as qual0, strand <> '-' as fw from {{gigars}}),
    t as (select r.*, unnest(regexp_extract_all(gigar, '{TOKEN}', 1)) as tok, unnest(range(1, len(regexp_extract_all(gigar, '{TOKEN}', 1)) + 1)) as ti from r),
    p as (select *, case when regexp_matches(tok, '^[A-Za-z]') then upper(tok[1]) end as letter,
                 case when regexp_matches(tok, '^[A-Za-z]') then 1 else coalesce(try_cast(nullif(regexp_extract(tok, '^([0-9]+)', 1), '') as int), 0) end as bases,
                 coalesce(try_cast(nullif(regexp_extract(tok, '^[(]([0-9]+)', 1), '') as int), 0) as clip,
                 coalesce(try_cast(nullif(regexp_extract(tok, '>([0-9]+)', 1), '') as int), 0) as gap, nullif(regexp_extract(tok, '>[0-9]+([+-])', 1), '') as op from t),
    q as (select *, coalesce(sum(bases) over w, 0) as b, coalesce(sum(case when op = '+' then gap else 0 end) over w, 0) as d, coalesce(sum(case when op = '-' then gap else 0 end) over w, 0) as ins,
                 first(clip) over (partition by read_id, strand, start, gigar order by ti) as lead,
                 12 + sum(case when op = '+' then gap when op = '-' then -gap else -clip end) over (partition by read_id, strand, start, gigar) as span
          from p window w as (partition by read_id, strand, start, gigar order by ti rows between unbounded preceding and 1 preceding)),
    s as (select *, substr(case when fw then seq0 else translate(seq0, 'ACGT', 'TGCA') end, cast(lead as int) + 1) as seq, substr(qual0, cast(lead as int) + 1) as qual from q where bases > 0),
    m as (select *, unnest(range(1, bases + 1)) as k from s),
    a as (select *, cast(case when fw then start + b + k - 1 + d else start + span - b - k - d end as bigint) as pos, substr(seq, cast(b + k + ins as int), 1) as rb, substr(qual, cast(b + k + ins as int), 1) as quals,
                 k = bases and letter is null and gap > 0 as last from m),
    n as (select read_id, pos, case when letter is null then rb when fw then letter else translate(letter, 'ACGT', 'TGCA') end as ref,
                 (case when letter is not null then case when fw then rb else lower(rb) end when fw then '.' else ',' end)
                 || (case when last and op = '-' then '+' || gap || substr(seq, cast(b + k + ins + 1 as int), gap)
                          when last and op = '+' then '-' || gap || (case when fw then substr('{REFERENCE}', cast(pos + 1 as int), gap) else substr('{REFERENCE}', greatest(1, cast(pos - gap as int)), cast(gap + least(0, pos - gap - 1) as int)) end) else '' end) as bases, quals from a),
    e as (select *, unnest(range(1, gap + 1)) as k, case when fw then start + b + bases - 1 + d else start + span - b - bases - d end as edge from s where op = '+'),
    f as (select read_id, cast(case when fw then edge + k else edge - k end as bigint) as pos from e),
    g as (select read_id, pos, substr('{REFERENCE}', cast(pos as int), 1) as ref, '*' as bases, '*' as quals from f where pos between 1 and 200)
    select 'ref' as chrom, pos, ref, 1 as depth, bases, quals, read_id from n union all select 'ref', pos, ref, 1, bases, quals, read_id from g"""


def observed(spark, sf_dir, make):
    reads = lens(spark, sf_dir, "gigars").select("read_id", F.lit(SEQ).alias("seq"), F.lit(QUAL).alias("qual"), F.concat_ws(":", F.lit("ref"), "strand", F.col("start").cast("string"), "gigar").alias("alignments"))
    contigs = spark.range(1).select(F.lit("ref").alias("contig"), F.lit(REFERENCE).alias("seq"))
    return make(reads, contigs).select("chrom", "pos", "ref", "depth", "bases", "quals", "read_id")


@query(OBSERVED)
def pileup_explode(spark, sf_dir):
    return observed(spark, sf_dir, pileup.pileup)


@query(OBSERVED)
def pileup_explode_function(spark, sf_dir):
    return observed(spark, sf_dir, pileup.pileup_by_function)


@query("select l_orderkey, l_linenumber, cast(l_orderkey // greatest(1, cast(ceil((select max(l_orderkey) + 1 from lineitem) / 7.0) as bigint)) as int) as chunk_id from lineitem")
def read_chunks(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    most = items.agg(F.max("l_orderkey")).first()[0]
    return items.select("l_orderkey", "l_linenumber", partition.read_chunk(F.col("l_orderkey") + 1, most + 1, 7).alias("chunk_id"))


@query("""
    select cast(i as int) as chunk_id, least(i * 12860 + 1, 900001) as line_0, least((i + 1) * 12860 + 1, 900001) as line_1 from range(70) t(i)
    where least(i * 12860 + 1, 900001) < least((i + 1) * 12860 + 1, 900001)""")
def line_pairs(spark, sf_dir):
    return partition.line_pairs(spark, 900_000, 70)


@query("select cast(i as int) as chunk_id, i * 1429 + 1 as read_0, least((i + 1) * 1429, 100000) as read_1 from range(70) t(i) where i * 1429 + 1 <= least((i + 1) * 1429, 100000)")
def read_ranges(spark, sf_dir):
    return partition.read_ranges(spark, 100_000, 70)


@query("""
    select n_nationkey as fastq_chunk, r_regionkey as fasta_chunk, printf('fa%04d-fq%04d', r_regionkey, n_nationkey) as task,
           cast(regexp_extract(printf('fa%04d-fq%04d', r_regionkey, n_nationkey), 'fa([0-9]+)', 1) as int) as parsed
    from nation cross join region""")
def chunk_grid(spark, sf_dir):
    fastq = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("chunk_id"))
    fasta = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("chunk_id"))
    return partition.task_grid(fasta, fastq).withColumn("parsed", partition.parse_task(F.col("task"))[0])


@query("select n_nationkey as chunk_id, n_name from nation where n_nationkey >= 3 and n_nationkey < 11")
def chunk_slice(spark, sf_dir):
    return partition.chunk_slice(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("chunk_id"), "n_name"), 3, 11)


@query("""
    with k as (select 'run/fa' || n_regionkey || '/fq' || n_nationkey as key from nation)
    select regexp_extract(key, '/(fa[0-9]+)/', 1) as part, string_agg(key, ',' order by key) as keys from k group by 1""")
def group_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "nation").select(F.concat(F.lit("run/fa"), F.col("n_regionkey").cast("string"), F.lit("/fq"), F.col("n_nationkey").cast("string")).alias("key"))
    return partition.keys_by_part(keys, "/(fa[0-9]+)/")


@query("select p_partkey as chunk_id from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)")
def missing_chunks(spark, sf_dir):
    cached = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("chunk_id"))
    return partition.missing_chunks(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id")), cached)


#: Documents as contigs of a file: a header of ten bytes, then n_chars bases.
FAIDX = """
    select 'd' || doc_id as contig, cast(coalesce(sum(n_chars + 10) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as offset_head,
           cast(coalesce(sum(n_chars + 10) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) + 10 as bigint) as offset_base from documents"""


def document_index(spark, sf_dir):
    return spark.sql(FAIDX.replace("from documents", "from {documents}"), documents=table(spark, sf_dir, "documents").where("doc_id is not null"))


@query(FAIDX)
def faidx(spark, sf_dir):
    return document_index(spark, sf_dir)


@query(f"""
    with f as ({FAIDX}), z as (select cast(sum(n_chars + 10) as bigint) as size from documents), st as (select size, cast(ceil(size / 37.0) as bigint) as step from z),
    c as (select unnest(range(0, 37)) * step as cut, size from st), l as (select * from c where cut < size),
    h as (select cut, size, f.contig, offset_head, offset_base from l asof join f on f.offset_head <= l.cut),
    b as (select distinct on (begin_) case when cut < offset_base then offset_head else cut end as begin_, contig, offset_head, offset_base, size from h)
    select cast(row_number() over (order by begin_) - 1 as int) as chunk_id, contig, offset_head, greatest(begin_, offset_base) as offset_base,
           lead(begin_, 1, size) over (order by begin_) - 1 as last_byte, greatest(begin_ - offset_base, 0) as first from b""")
def fasta_intervals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    size = docs.agg(F.sum(F.col("n_chars") + 10)).first()[0]
    return partition.fasta_chunks(document_index(spark, sf_dir), size, 37)


@query("""
    with p as (select event_id, user_id, ts from events where event_type = 'purchase'),
    v as (select user_id, ts, max(event_id) as event_id from events where event_type = 'click' group by 1, 2)
    select p.event_id, p.user_id, v.event_id as view_asof from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts""")
def asof_window(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("view"))
    found = asof.as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "ts", ("user_id",), ("view",), tie=F.col("view"))
    return found.select("event_id", "user_id", "view_asof")


@query("""
    with p as (select event_id, user_id, ts from events where event_type = 'purchase'),
    v as (select user_id, ts, min(event_id) as event_id from events where event_type = 'click' group by 1, 2)
    select p.event_id, p.user_id, v.event_id as view_asof from p asof left join v on p.user_id = v.user_id and p.ts <= v.ts""")
def asof_forward(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("view"))
    found = asof.as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "ts", ("user_id",), ("view",), forward=True, tie=F.col("view"))
    return found.select("event_id", "user_id", "view_asof")


@query("""
    with p as (select l_orderkey as line_0, l_orderkey + 400 as line_1 from lineitem group by 1),
    w as (select o_orderkey as line, max(o_orderkey * 31) as byte from orders group by 1)
    select line_0, line_1, coalesce(b.byte, 0) as range_0, coalesce(e.byte, 999999999) as range_1
    from p asof left join w b on p.line_0 >= b.line asof left join w e on p.line_1 <= e.line""")
def line_byte_ranges(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line_0"), (F.col("l_orderkey") + 400).alias("line_1")).distinct()
    windows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_number"), (F.col("o_orderkey") * 31).alias("compressed_byte"))
    return asof.line_ranges(pairs, windows, 999_999_999)


@query('select arg_min("window", (abs(line - 1234), line)) as "window" from (select o_custkey as "window", o_orderkey as line from orders) x')
def nearest_window(spark, sf_dir):
    windows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("window"), F.col("o_orderkey").alias("line_number"))
    return asof.nearest(windows, 1234)


@query("select event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as delta from events")
def stage_deltas(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return runs.deltas(table(spark, sf_dir, "events"), micros, "user_id", "event_id").select("event_id", "user_id", "delta")


@query("select stage, cast(sum(bytes * 3) as bigint) as cost from {moves} group by rollup (stage)")
def stage_cost(spark, sf_dir):
    return runs.stage_cost(lens(spark, sf_dir, "moves"), F.col("bytes"), F.lit(3))


@query("""
    with e as (select stage, count(*) as n, cast(sum(bytes) as bigint) as total from {moves} group by stage)
    select stage, n, total, total // n as mean, cast(total * 1000000 // (select sum(total) from e) as bigint) as share_ppm from e""")
def transfer_stats(spark, sf_dir):
    return runs.transfers(lens(spark, sf_dir, "moves"))


STAGES = ["click", "error", "purchase", "signup", "view"]


@query("select cast(fn % 4 as bigint) as phase, " + ", ".join(f"cast(coalesce(sum(bytes) filter (stage = '{s}'), 0) as bigint) as \"{s}\"" for s in STAGES) + " from {moves} group by 1")
def phase_seconds(spark, sf_dir):
    return runs.phase_seconds(lens(spark, sf_dir, "moves").withColumn("phase", F.col("fn") % 4), STAGES, seconds="bytes")


@query("select cast(fn % 4 as bigint) as phase, " + ", ".join(f"count(*) filter (stage = '{s}') as \"{s}\"" for s in STAGES) + " from {moves} group by 1")
def function_counts(spark, sf_dir):
    return runs.function_counts(lens(spark, sf_dir, "moves").withColumn("phase", F.col("fn") % 4), STAGES)


@query("select doc_id, cast(i as int) as line_no, l as line from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(0, len(string_split(text, chr(10))))) as i from documents) x")
def split_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


@query("select doc_id, translate(text, 'ACGTacgt', 'TGCAtgca') as text from documents")
def complement(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", dna.complement(F.col("text")).alias("text"))


@query("select page_id, regexp_extract('>' || url || ' ' || page_id, '^>?([^ ]+)', 1) as contig from pages")
def header_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", dna.header_name(F.concat(F.lit(">"), "url", F.lit(" "), F.col("page_id").cast("string"))).alias("contig"))


@query("select page_id, translate(url, '._-!/·¡', '') as name, printf('fq%04d', page_id) as chunk from pages")
def clean_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", dna.strip_symbols(F.col("url")).alias("name"), dna.chunk_id("fq", F.col("page_id")).alias("chunk"))


@query("""
    select l_orderkey, l_linenumber, l_quantity, l_partkey, substr('ACGTACGTACGT', l_linenumber + 1) as clipped, upper(substr('acgtnacgtn', cast(l_partkey % 7 + 1 as int), 3)) as ref
    from lineitem""")
def clip_and_slice(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", dna.clip_start(F.lit("ACGTACGTACGT"), F.col("l_linenumber")).alias("clipped"),
        dna.reference_slice(F.lit("acgtnacgtn"), (F.col("l_partkey") % 7 + 1).cast("int"), F.lit(3)).alias("ref"))


@query("select page_id, array_to_string(list_transform(regexp_extract_all(url, '([0-9]+)', 1), lambda x: cast(cast(x as bigint) as varchar)), ',') as numbers from pages")
def listed_numbers(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(dna.numbers(F.col("url")), lambda x: x.cast("string")), ",").alias("numbers"))


@query("""
    with d as (select 'd' || doc_id as contig, upper(text) as text from documents), b as (select item_id as read_id, upper(text) as text from benchmark),
    i as (select contig, unnest(list_transform(range(0, len(text) - 15), lambda i: substr(text, cast(i + 1 as int), 16))) as kmer, unnest(range(0, len(text) - 15)) as pos from d where len(text) >= 16),
    s as (select read_id, unnest(list_transform(range(0, len(text) - 15, 8), lambda i: substr(text, cast(i + 1 as int), 16))) as kmer, unnest(range(0, len(text) - 15, 8)) as at_ from b where len(text) >= 16)
    select distinct read_id, contig, pos - at_ as diagonal from s join i on s.kmer = i.kmer""")
def kmer_seed(spark, sf_dir):
    contigs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("contig"), F.col("text").alias("seq"))
    reads = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read_id"), F.col("text").alias("seq"))
    return kmer.seed_hits(reads, kmer.kmer_index(contigs), 16, 8)


#: Customers as contigs: 160 bases made of digests, and a header of two words. Reads are 32 or 64 of their bases.
HEX, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"
CONTIG = "translate(" + " || ".join(f"md5('{k}-' || c_custkey)" for k in range(5)) + f", '{HEX}', '{BASES}')"
CONTIGS = f"select c_custkey as ord, 'c' || c_custkey as contig, {CONTIG} as seq from {{customer}}"
READS = f"select c_custkey as ord, 'r' || c_custkey as name, translate(md5('r-' || c_custkey), '{HEX}', '{BASES}') as seq, md5('q-' || c_custkey) as qual from {{customer}}"


def made(spark, sf_dir, sql):
    return spark.sql(sql, customer=table(spark, sf_dir, "customer"))


def plain_sql(sql):
    return sql.replace("{customer}", "customer")


def fasta_folder(spark, sf_dir):
    path = storage.shared_folder(spark, "fasta")
    fasta.write_fasta(made(spark, sf_dir, CONTIGS), path)
    return path


@query(f"select contig, cast(k * 61 as bigint) as place, substr(seq, cast(60 * k + 1 as int), 60) as line from ({plain_sql(CONTIGS)}) c, range(3) t(k)")
def fasta_lines(spark, sf_dir):
    """Sequence lines of FASTA files, by their byte after the end of their contig's header."""
    path = fasta_folder(spark, sf_dir)
    heads = fasta.faidx(spark, path).select("file", "contig", "offset_base")
    return fasta.read_lines(spark, path).join(heads, ["file", "contig"]).select("contig", (F.col("offset") - F.col("offset_base")).alias("place"), "line")


@query(f"select contig, cast(length(contig) + 2 as bigint) as head_bytes from ({plain_sql(CONTIGS)}) c")
def fasta_index(spark, sf_dir):
    return fasta.faidx(spark, fasta_folder(spark, sf_dir)).select("contig", (F.col("offset_base") - F.col("offset_head")).alias("head_bytes"))


@query(f"select contig, seq from ({plain_sql(CONTIGS)}) c")
def fasta_contigs(spark, sf_dir):
    return fasta.read_contigs(spark, fasta_folder(spark, sf_dir)).select("contig", "seq")


@query(f"select contig, cast(3 as bigint) as n from ({plain_sql(CONTIGS)}) c")
def fasta_names(spark, sf_dir):
    return fasta.contig_names(fasta.read_lines(spark, fasta_folder(spark, sf_dir)))


@query(f"select name, seq, qual from ({plain_sql(READS)}) r")
def fastq_reads(spark, sf_dir):
    """Reads written as gzip FASTQ and read back."""
    path = storage.shared_folder(spark, "fastq")
    fastq.write_fastq(made(spark, sf_dir, READS), path)
    return fastq.read_fastq(spark, path).select("name", "seq", "qual")


@query(f"select * from (select row_number() over (order by ord) as read_no, name from ({plain_sql(READS)}) r) x where read_no between 41 and 120")
def fastq_range(spark, sf_dir):
    """Records 41 to 120 of one plain file: the range is what the operator takes."""
    path = storage.shared_folder(spark, "fastq")
    fastq.write_fastq(made(spark, sf_dir, READS).repartition(1).sortWithinPartitions("ord"), path, "none")
    return fastq.read_fastq(spark, path, 41, 120).select("read_no", "name")


@query(f"""
    with c as (select c.contig as a, r.name as b, c.ord from ({plain_sql(CONTIGS)}) c join ({plain_sql(READS)}) r on c.ord = r.ord)
    select row_number() over (order by ord) as line_no, a, b from c""")
def zipped_lines(spark, sf_dir):
    """Two files side by side, line by line."""
    def lines(sql, column):
        path = storage.shared_folder(spark, "lines")
        made(spark, sf_dir, sql).repartition(1).sortWithinPartitions("ord").select(column).write.text(path)
        return blocks.numbered_lines(spark, path)

    return blocks.zip_lines(lines(CONTIGS, "contig"), lines(READS, "name"))


@query(f"select ord as read_id, 'r' || ord as name, '1:0:0:0' as summary, contig || ':+:33:64' as alignments from ({plain_sql(CONTIGS)}) c")
def align_reads(spark, sf_dir):
    """Each contig's bases 33 to 96 as a read, which aligns where it comes from."""
    contigs = made(spark, sf_dir, CONTIGS)
    reads = contigs.select(F.col("ord").alias("read_id"), F.concat(F.lit("r"), F.col("ord").cast("string")).alias("name"), F.substring("seq", 33, 64).alias("seq"), F.lit("I" * 64).alias("qual"))
    return kmer.align(reads, contigs.select("contig", "seq")).select("read_id", "name", "summary", "alignments")


@query("select name, seq, qual, summary, alignments from {maps}")
def map_records(spark, sf_dir):
    """Records of single reads written as text and read back."""
    path = storage.shared_folder(spark, "map")
    mapfile.write_map(lens(spark, sf_dir, "maps"), path)
    return mapfile.read_map(spark, path)


@query("select name, seq, 'TTTT' as seq2, qual, 'JJJJ' as qual2, summary, alignments from {maps}")
def map_records_paired(spark, sf_dir):
    path = storage.shared_folder(spark, "map")
    mapfile.write_map(lens(spark, sf_dir, "maps").withColumns({"seq2": F.lit("TTTT"), "qual2": F.lit("JJJJ")}), path, paired=True)
    return mapfile.read_map(spark, path, paired=True)


@query(MERGED)
def mpileup_text(spark, sf_dir):
    """The merged pileup written in order as one text and read back."""
    path = storage.shared_folder(spark, "mpileup")
    mpileup.write_text(merge.merge_pileups(lens(spark, sf_dir, "obs")), path, single_file=True)
    return mpileup.read_text(spark, path)


@query(MERGED)
def mpileup_table(spark, sf_dir):
    """The same as Parquet, partitioned by contig."""
    path = storage.shared_folder(spark, "pileups")
    mpileup.write_pileups(merge.merge_pileups(lens(spark, sf_dir, "obs")), path)
    return mpileup.read_pileups(spark, path)


@query(f"""
    with o as (select pos from {{obs}}), t as (select max(pos) as top from o), b as (select unnest(range(1, cast(ceil(top / {WIDTH}.0) as bigint) + 1)) as bin, top from t),
    n as (select cast(ceil(pos / {WIDTH}.0) as bigint) as bin, count(*) as n from o group by 1)
    select cast(least(b.bin * {WIDTH}, top) as bigint) as upper, coalesce(n.n, 0) as n from b left join n on b.bin = n.bin""")
def histogram_text(spark, sf_dir):
    path = storage.shared_folder(spark, "histogram")
    mpileup.write_histogram(ranges.binned_histogram(lens(spark, sf_dir, "obs"), WIDTH), path)
    return mpileup.read_histogram(spark, path)


@query('select o_custkey as "window", o_orderkey as compressed_byte, o_orderkey * 3 as uncompressed_byte, o_orderkey + 1 as line_number from orders')
def window_listing(spark, sf_dir):
    """An index tool's listing, parsed, stored as a table and read back."""
    listed = table(spark, sf_dir, "orders").select(F.format_string("#%d: @ %d / %d L%d ( 32768 @20 )", "o_custkey", "o_orderkey", F.col("o_orderkey") * 3, F.col("o_orderkey") + 1).alias("value"))
    path = storage.shared_folder(spark, "windows")
    fastq.parse_listing(listed).write.parquet(path)
    return spark.read.parquet(path).select("window", "compressed_byte", "uncompressed_byte", "line_number")


@query("select read_id, cast(0 as int) as aln, 'ref' as chrom, strand, start, gigar from {gigars} where gigar <> '4>2+8'")
def double_gaps(spark, sf_dir):
    """Alignments without two gaps in a row; those of one kind get a second gap here."""
    gigars = lens(spark, sf_dir, "gigars").withColumn("gigar", F.regexp_replace("gigar", "^4>2[+]8$", "4>2+>1-8"))
    reads = gigars.select("read_id", F.lit(SEQ).alias("seq"), F.lit(QUAL).alias("qual"), F.concat_ws(":", F.lit("ref"), "strand", F.col("start").cast("string"), "gigar").alias("alignments"))
    return pileup.explode_alignments(reads).select("read_id", "aln", "chrom", "strand", F.col("start").cast("long").alias("start"), "gigar")


@query("select stage, cast(sum(bytes) as double) as seconds, cast(sum(bytes) * 2 as double) as cost from {moves} group by rollup (stage)")
def compute_cost(spark, sf_dir):
    moves = lens(spark, sf_dir, "moves").select("stage", F.lit(0.0).alias("t0"), F.col("bytes").cast("double").alias("t1"))
    return runs.compute_cost(moves, 2.0)


@query("select stage, cast(round(sum(bytes) * 1.0 + sum(bytes) * 0.5) as bigint) as cost from {moves} group by rollup (stage)")
def scan_cost(spark, sf_dir):
    moves = lens(spark, sf_dir, "moves").select("stage", (F.col("bytes") * 1_000_000_000).alias("bytes_scanned"), (F.col("bytes") * 1000).alias("kb_returned"))
    return runs.scan_cost(moves, 1.0, 0.5).select("stage", F.round("cost").cast("long").alias("cost"))


@query("select page_id, page_id % 4 < 3 as found from pages")
def accessions(spark, sf_dir):
    text = F.concat(F.element_at(F.array(*map(F.lit, ("SRR", "ERR", "DRR", "SRX"))), (F.col("page_id") % 4 + 1).cast("int")), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", dna.is_accession(text).alias("found"))


@query("select translate(n_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as value from nation")
def piped_lines(spark, sf_dir):
    """Lines through a program."""
    return external.pipe(table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")), ["tr", "A-Z", "a-z"])
