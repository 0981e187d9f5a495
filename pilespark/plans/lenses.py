"""The test tables read as sequencing data, by SQL that Spark and DuckDB share but for the pairs marked."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name -> SQL over the test tables; {chr} and {int} style differences are kept out by using what both engines have.
LENSES = {
    # raw base observations
    "obs": """
        select l_returnflag as chrom, l_partkey as pos, substr('ACGT', cast(l_partkey % 4 as int) + 1, 1) as ref, 1 as depth,
               case l_linenumber % 3 when 0 then '.' when 1 then ',' else substr('ACGT', cast(l_suppkey % 4 as int) + 1, 1) end as bases,
               chr(cast(33 + l_quantity as int)) as quals, l_orderkey as read_id, l_linenumber as line_no
        from lineitem""",
    # one row for each read and reference chunk
    "idx": "select l_orderkey as read_id, cast(l_suppkey % 4 as int) as fasta_chunk, cast(min(l_linenumber) as int) as idx from lineitem group by 1, 2",
    # aligner output; a tenth is unmapped, some have suboptimal matches only
    "maps": """
        select l_orderkey as read_id, cast(l_suppkey % 4 as int) as fasta_chunk, l_linenumber as line_no,
               cast(l_linenumber as string) as name, 'ACGT' as seq, 'IIII' as qual,
               concat(cast(case when l_linenumber % 3 = 0 then 1 else 0 end as string), ':', cast(cast(l_quantity as int) % 3 as string), ':', cast(l_suppkey % 2 as string), '+', cast(l_linenumber % 2 as string), ':1') as summary,
               case when cast(l_quantity as int) % 10 = 0 then '-'
                    else concat('c', cast(l_partkey % 9 as string), ':+:', cast(l_partkey as string), ':4,c', cast(l_suppkey % 9 as string), ':-:', cast(l_suppkey as string), ':2A1,c1:+:7:4,c2:-:8:4') end as alignments
        from lineitem""",
    # alignments on a reference of repeated ACGT; keyed by all of a line's numbers
    "gigars": """
        select l_orderkey * 1000 + l_linenumber * 100 + cast(l_quantity as int) as read_id,
               case cast(max(l_quantity) as int) % 6
                    when 0 then '12' when 1 then '5A6' when 2 then '(2)10' when 3 then '4>2+8' when 4 then '4>2-6' else '3T>1+8' end as gigar,
               case when max(l_suppkey) % 2 = 0 then '+' else '-' end as strand, max(l_partkey) % 90 + 1 as start
        from lineitem
        group by 1""",
    # events of a run: what each function moved, in whole units, and when
    "moves": "select event_id as id, user_id as fn, event_type as stage, cast(floor(value * 100) as bigint) as bytes from events where value is not null",
}


def lens_sql(name: str) -> str:
    return LENSES[name]


def lens(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The lens over the tables of a data folder."""
    sql = LENSES[name]
    tables = set(re.findall(r"from (\w+)\b", sql))
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(re.sub(r"from (\w+)\b", r"from {\1}", sql), **frames)
