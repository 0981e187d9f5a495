"""A corpus from documents: toxic ones go, lines and near copies are kept once, benchmark leaks go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilespark.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from pilespark.llm.common import Scratch, small, table

#: Ids that may be broadcast, 8 MB; more are joined by a shuffle.
BROADCAST_IDS = 500_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `key`, which tells rows apart by id and text, nulls included: rows of one key repeat both."""
    return docs.withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learnt from the labels outside the held-out fold finds toxic go; all others stay whole.

    Only a row's text decides, so rows with null ids or repeated ids are judged like others and rows that repeat share
    one fate. Null and empty texts hold no evidence and stay. Very long texts are read whole. No documents give none;
    without usable labels all stay. Columns beyond those of documents go.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.without_toxic(docs.select(*COLUMNS), model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, closely or exactly, stay once; documents that had words and keep none go.

    The line of the least (id, hash of the text, line number) stays, rows with a null id last; rows that repeat id and text
    keep the same lines. Null and empty texts and those of white space only stay as they are. n_chars is counted anew (null
    for a null text). No documents give none. Columns beyond those of documents go.
    """
    cleaned = line_dedup.line_dedup(docs.select(*COLUMNS))
    left = cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of the least (id, hash of the row) stays.

    Rows are told apart by id and text: of rows that repeat both one stays, a repeated id with another text is another
    document, and rows with a null id take part and come last in the order of ids. Null, empty and blank texts are in no
    class and stay, once for each id. No documents give none. Columns beyond those of documents go.
    """
    rows = Scratch(spark, "rows").keep(keyed(docs.select(*COLUMNS)).dropDuplicates(["key"]))
    classes = ngram_join.ngram_join(rows.select(F.col("key").alias("doc_id"), "text"))
    marked = Scratch(spark, "copies").keep(classes.where("n_links > 0").select(F.col("doc_id").alias("key"), "class_id"))
    members = rows.select("key", F.col("doc_id").alias("id")).join(small(marked, BROADCAST_IDS), "key")
    first = members.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("x")).select(F.col("x.key").alias("key"))
    gone = Scratch(spark, "gone").keep(marked.select("key").join(first, "key", "left_anti"))
    return rows.join(small(gone, BROADCAST_IDS), "key", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark passage go.

    Rows are told apart by id and text, null ids included, so a clean row stays though another row of its id goes, and rows
    that repeat both go together. Null and empty texts overlap nothing and stay. No documents give none, and an empty
    benchmark takes none away. Columns beyond those of documents go.
    """
    rows = keyed(docs.select(*COLUMNS))
    leaks = decontaminate.contaminated(rows.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = Scratch(spark, "leaks").keep(leaks.select(F.col("doc_id").alias("key")).distinct())
    return rows.join(small(gone, BROADCAST_IDS), "key", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each part of each document goes, as best_fit() says.

    Null and empty texts go nowhere (one row with a null bin); longer texts than a bin are cut; rows that repeat are
    duplicates of each other and lie in different bins; null ids and sources stay null. No documents give no rows.
    """
    return packing.best_fit(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_documents),
    ("decontamination", drop_leaks),
    ("best_fit_packing", pack),
]

#: SQL cannot express the fitted model, the signatures and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
