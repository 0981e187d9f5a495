"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, line_dedup, ngram_join, packing, secrets, suffix_dedup, tokens, topk, toxicity
from .common import table

TOKENIZER = "piece_bpe_32k.model"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    found = toxicity.toxicity(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path(TOKENIZER)))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(table(spark, sf_dir, "documents")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_exact_topk": op4_exact_topk,
    "op5_license_scan": op5_license_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_secret_scan": op8_secret_scan,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE: dict[str, str] = {
    "op5_license_scan": licenses.oracle(),
    "op4_exact_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
            from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
        r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
        select * from r where rank <= 10
    """,
    "op9_ngram_jaccard_join": r"""
        with recursive w as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x20]+'), lambda x: x <> '') as w from documents where doc_id is not null),
        s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
        n as (select doc_id, count(*) as n from s group by doc_id),
        x as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
        l as (select a, b from x join n as na on na.doc_id = a join n as nb on nb.doc_id = b where 10 * c >= 8 * (na.n + nb.n - c)),
        r(node, root) as (select doc_id, doc_id from w union select l.b, r.root from r join l on l.a = r.node),
        k as (select a, count(*) as n_links from l group by a)
        select node as doc_id, min(root) as class_id, coalesce(max(n_links), 0) as n_links from r left join k on k.a = r.node group by node
    """,
    "op10_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
        p as (select doc_id, h, unnest(range(0, n - 199)) as i from d where n >= 200),
        s as (select doc_id, i, md5_number(substr(h, cast(2 * i + 1 as int), 400)) as s from p),
        t as (select s from s group by s having count(*) > 1),
        m as (select doc_id, i from s semi join t on s.s = t.s),
        g as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as gap from m),
        k as (select doc_id, i, count(*) filter (gap is null or gap > 200) over (partition by doc_id order by i) as k from g),
        r as (select doc_id, min(i) as b, max(i) + 200 as e from k group by doc_id, k.k),
        o as (select doc_id, b, e, lead(b) over (partition by doc_id order by b) as nb from r),
        z as (select d.doc_id, d.n, d.h, count(o.b) as n_spans, coalesce(sum(o.e - o.b), 0) as n_removed, min(o.b) as first_b,
              string_agg(substr(d.h, cast(2 * o.e + 1 as int), cast(2 * (coalesce(o.nb, d.n) - o.e) as int)), '' order by o.b) as tail from d left join o on o.doc_id = d.doc_id group by d.doc_id, d.n, d.h)
        select doc_id, n as n_bytes, cast(n_removed as bigint) as n_removed, n_spans,
               sha256(unhex(case when n_spans = 0 then h else substr(h, 1, cast(2 * first_b as int)) || tail end)) as kept_sha256 from z
    """,
}
