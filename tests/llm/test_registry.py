"""Registered queries against their SQL, and the pipeline's rules."""

import duckdb
import pytest

import corpus_pipeline
from pilespark.llm import toxicity
from pilespark.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = con.execute(f"select {', '.join(columns)} from ({ORACLE[name]}) q").fetchall()
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(want)


def test_toxicity_on_held_out_rows(spark):
    r = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").selectExpr("count_if(toxic = predicted) / count(*) as right").first()
    assert r["right"] > 0.95


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    toxic = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").where(~toxicity.held_out()).select("doc_id").collect()}
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        rows = made.collect()
        if name != "best_fit_packing":
            assert made.columns == columns
            assert 0 < len(rows) <= before
            before = len(rows)
            docs = spark.createDataFrame(rows, made.schema)
        if name == "toxicity":
            assert len(toxic & {r["doc_id"] for r in rows}) <= 0.2 * len(toxic)
            text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
            assert all(r["text"] == text[r["doc_id"]] for r in rows)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}


def stage_rows(spark, tmp_path, texts):
    """Documents with null and repeated ids, rows that repeat, clashing columns, and the tables that stages read."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, class_id int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, 7, 7) for i, t in texts], columns)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, LEAK), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs


LEAK = " ".join(f"leak{i}" for i in range(30))
CLEAN = " ".join(f"clean{i}" for i in range(30))
OTHER = " ".join(f"other{i}" for i in range(30))
#: stage -> (id, text) of the rows that stay, of ODD.
ODD = [(1, LEAK), (None, LEAK), (1, CLEAN), (2, OTHER), (2, OTHER), (None, OTHER), (3, None), (None, None), (4, ""), (5, "\r\n \n"), (6, "x " * 20_000 + "end")]
STAY = {
    "toxicity": ODD,
    "line_dedup": [(1, LEAK), (1, CLEAN), (2, OTHER), (2, OTHER), (3, None), (None, None), (4, ""), (5, "\r\n \n"), (6, "x " * 20_000 + "end")],
    "ngram_jaccard_join": [(1, LEAK), (1, CLEAN), (2, OTHER), (3, None), (None, None), (4, ""), (5, "\r\n \n"), (6, "x " * 20_000 + "end")],
    "decontamination": [x for x in ODD if x[1] != LEAK],
}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_of_odd_rows(spark, tmp_path, name):
    docs = stage_rows(spark, tmp_path, ODD)
    stage = dict(corpus_pipeline.STAGES)[name]
    made = stage(spark, docs, str(tmp_path))
    rows = made.collect()
    if name == "best_fit_packing":
        assert sum(r["bin_id"] is None for r in rows) == 4 and sum(r["n_words"] for r in rows) == sum(len((t or "").split()) for _, t in ODD)
    else:
        assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        key = lambda x: (str(x[0]), str(x[1]))
        assert sorted(((r["doc_id"], r["text"]) for r in rows), key=key) == sorted(STAY[name], key=key)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
