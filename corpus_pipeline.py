"""Documents to training shards: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.llm import decontam, langid, mixing, sharding, simhash
from bandwright.llm.shared import cut, read_table

SHARDS = 16
#: A prediction below this posterior is no prediction.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, `und` and unsure ones left out."""
    # columns go by numbers meanwhile, so none can clash with the prediction's
    at = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    learn = langid.learn_rows(plain, at["doc_id"], at["lang"])
    carry = [n for c, n in at.items() if c not in ("doc_id", "text")]
    found = langid.identify(plain, learn, at["doc_id"], at["text"], at["lang"], carry=carry, keep_text=True)
    sure = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return sure.select(*[F.col(n).alias(c) for c, n in at.items()])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its weight asks for."""
    return mixing.mixed_rows(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and place in it; every shard holds the sources alike."""
    return sharding.sharded_rows(docs, "source", SHARDS)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing sources", mix_sources),
    ("sharding", deal_shards),
]

#: Trained byte models, fingerprints and seeded choices are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
