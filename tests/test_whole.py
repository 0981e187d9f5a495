"""Queries that run over all rows of their tables, against brute force."""

import bisect

from pilespark.plans.catalogue import QUERIES, table
from pilespark.plans.lenses import lens

SF = "/root/testdata/sf0.001"


def test_line_byte_ranges_of_all_pairs_and_windows(spark):
    lines = sorted({r[0] for r in table(spark, SF, "orders").select("o_orderkey").collect()})
    keys = {r[0] for r in table(spark, SF, "lineitem").select("l_orderkey").collect()}
    want = set()
    for k in keys:
        b, e = bisect.bisect_right(lines, k), bisect.bisect_left(lines, k + 400)
        want.add((k, k + 400, lines[b - 1] * 31 if b else 0, lines[e] * 31 if e < len(lines) else 999_999_999))
    got = QUERIES["line_byte_ranges"](spark, SF).collect()
    assert len(got) == len(keys) and set(map(tuple, got)) == want


def test_parts_make_the_whole(spark):
    assert QUERIES["union_parts"](spark, SF).count() == lens(spark, SF, "obs").count()


def test_nearest_of_all_windows(spark):
    rows = [tuple(r) for r in table(spark, SF, "orders").select("o_custkey", "o_orderkey").collect()]
    assert QUERIES["nearest_window"](spark, SF).first()[0] == min(rows, key=lambda r: (abs(r[1] - 1234), r[1]))[0]
