"""From raw documents to shards: five stages, each an operator of ``reliefgrid.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.llm import decontaminate, mixing, quality, sharding, simhash
from reliefgrid.llm.tables import one_per_key, read
from reliefgrid.runtime import scratch_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model scores as good; it learns from the labels of the documents it is given."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return docs.filter(quality.score(F.col("text"), model) >= quality.THRESHOLD)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; trees over SimHashes link, exact Jaccard confirms."""
    return one_per_key(docs, simhash.near_duplicates(docs).filter("_keep"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with tempered shares of tokens per source, language and topic."""
    return mixing.sampled(docs)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    return sharding.sharded(docs)


STAGES = [("quality", good_quality), ("near_dedup", one_of_near_copies), ("decontaminate", without_benchmark), ("mix", mixed), ("shard", in_shards)]

#: The classifier and the fingerprints have no SQL form; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
