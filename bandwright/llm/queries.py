"""The registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, mixing, nndescent, quality, sharding, simhash, suffixes, urls, warc
from .shared import fold, read_table
from .suffix_sql import remove_repeats_sql
from .url_sql import filter_urls_sql

RULES = [
    urls.Rule("com", "/en/", False),
    urls.Rule("example.com", "/en/7", True),
    urls.Rule("net", "/de/", True),
    urls.Rule("example.net", "/de/8", False),
    urls.Rule("org", "/es/", False),
]
SHARDS = 16


def op1_url_markov_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(read_table(spark, sf_dir, "pages"))


def op3_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(read_table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op4_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.bradley_terry(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    dealt = sharding.interleave(docs, "source", ["doc_id", "text_crc32", "size"], SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn_rows(docs))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_markov_ratio, op2_warc_reassembly, op3_budget_mix, op4_bradley_terry, op5_stratified_shards,
        op6_spaced_seeds, op7_suffix_dedup, op8_simhash_trie, op9_nn_descent, op10_ppm_language,
    )
}

ORACLE_SQL = {
    "op1_url_markov_ratio": filter_urls_sql(RULES),
    "op2_warc_reassembly": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        h AS (SELECT d, min(page_id) AS head FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN page_id > head THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > head THEN head END AS refers_to
        FROM p LEFT JOIN h ON p.d = h.d AND p.n >= 100
    """,
    "op7_suffix_dedup": remove_repeats_sql(),
    "op9_nn_descent": """
        WITH RECURSIVE sound AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.93 ELSE false END
        ), reach AS (
            SELECT vec_id AS u, vec_id AS v FROM embeddings
            UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
        ), least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
        degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings LEFT JOIN least ON vec_id = least.u LEFT JOIN degree ON vec_id = degree.u
    """,
}
