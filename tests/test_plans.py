"""Plans that must hold at scale: no products, partial aggregates, pruned scans."""

import pytest

from pilespark.operators import merge, pileup, ranges, stratum
from pilespark.plans.catalogue import QUERIES
from pilespark.plans.lenses import lens

SF = "/root/testdata/sf0.001"
# lists of chunks, one row, cuts against contigs, and the cross-check form on one contig
SMALL_PRODUCTS = {"chunk_grid", "line_byte_ranges", "fasta_intervals", "pileup_explode_function"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SMALL_PRODUCTS))
def test_no_products(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_merge_aggregates_before_its_shuffle(spark):
    plan = plan_of(merge.merge_pileups(lens(spark, SF, "obs")))
    assert "partial_listagg" in plan and plan.count("Exchange hashpartitioning") == 1
    plan = plan_of(merge.base_counts(lens(spark, SF, "obs")))
    assert "partial_count" in plan and plan.count("Exchange hashpartitioning") == 1


def test_best_stratum_is_one_shuffle_beyond_the_lens(spark):
    index = lens(spark, SF, "maps").select("read_id", "fasta_chunk", "line_no").withColumnRenamed("line_no", "idx")
    assert plan_of(stratum.best_per_read(index)).count("Exchange hashpartitioning") == 1


def test_placed_tokens_need_no_shuffle(spark):
    reads = spark.createDataFrame([(1, "ACGT", "IIII", "c:+:1:4")], "read_id long, seq string, qual string, alignments string")
    assert "Exchange" not in plan_of(pileup.placed_tokens(pileup.explode_alignments(reads)))


def test_scans_read_what_they_need(spark):
    plan = plan_of(ranges.position_histogram(lens(spark, SF, "obs")))
    assert "ReadSchema: struct<l_partkey:bigint>" in plan
