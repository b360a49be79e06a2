"""The corpus pipeline: documents without the toxic, one of each group of near
duplicates, without benchmark passages, mixed to target source weights, and
sharded.  Every stage takes and returns the columns of ``documents``; the last
adds the shard."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.llm import decontam, minhash, mix, queries, shard, toxicity
from ledgerflow.llm.common import shared_dir

NEAR_PERCENT = 80  # of the union of two documents' word shingles; op6's own contract is 85


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity models reject."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(docs, spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash.keep_first(docs, percent=NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark passages."""
    return decontam.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's Poisson rate has it, shuffled."""
    return mix.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the shard of the hash tree."""
    return shard.with_shard(docs)[0]


STAGES = [
    ("kneser_ney_toxicity", drop_toxic),
    ("minhash_neardup", near_duplicates),
    ("positional_decontamination", decontaminate),
    ("poisson_mixing", mix_sources),
    ("hash_tree_sharding", assign_shards),
]
ORACLE_SQL = None  # models and near-duplicate components have no SQL; tests hold brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
