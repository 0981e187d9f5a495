"""Every query of the catalogue against its SQL in DuckDB, and plans."""

import duckdb
import pytest

from pilespark.operators import merge
from pilespark.plans.catalogue import ORACLE, QUERIES
from pilespark.plans.lenses import lens

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = con.execute(f'select {", ".join(chr(34) + c + chr(34) for c in columns)} from ({ORACLE[name]}) q').fetchall()
    assert plain(found.select(columns).collect()) == plain(want)


def test_scan_is_pruned(spark):
    plan = merge.scan_range(lens(spark, SF, "obs"), 1, 9).select("pos")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_partkey,1)" in plan and "ReadSchema: struct<l_partkey:bigint>" in plan
