"""The queries opN_<name>: each applies its operator to its whole table; SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.llm import centroids, chat, decontaminate, maintext, mixing, packing, quality, sharding, simhash, suffixes, syncmers, trie, warc
from reliefgrid.llm.tables import read
from reliefgrid.runtime import local_table


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are near copies of each other? Vantage-point trees at radius 2."""
    found = simhash.components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How good is every document? Gated attention over its passages."""
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold a passage of the benchmark, and where?"""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("doc_key")


def op10_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which shard does every document go to? Copies together, counts equal."""
    return sharding.assign(read(spark, sf_dir, "documents")).drop("group")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted turn by turn, and what is read back from the output."""
    own = r"\### Assistant: </turn> ok"
    told = local_table(spark, [(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(told)
    return chat.digests(chat.format_turns(turns))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return maintext.main_texts(read(spark, sf_dir, "pages"))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and plain-text records of every page, taken as a response."""
    pages = warc.page_responses(read(spark, sf_dir, "pages"), "2024-01-01T00:00:00Z")
    return warc.derivatives(pages, ["page_id"])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With what chance does each document stay, for tempered shares of sources, languages and topics?"""
    return mixing.mix(read(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 6))


def op2_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near they are."""
    return syncmers.fingerprints(read(spark, sf_dir, "documents"))


def op5_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which passages of fifty words or more does each document share with others?"""
    return suffixes.repeated_passages(read(spark, sf_dir, "documents"))


def op11_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of eight centroids is every vector nearest to, after ten exact rounds? Ptolemaic bounds prune."""
    return centroids.clusters(read(spark, sf_dir, "embeddings")).drop("compared")


def op12_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which piece of which training sequence does every token go to? Documents in Hilbert order."""
    return packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What do rebuilt conversations share? Every node of their prefix trie; Count-min estimates spare the tails."""
    return trie.prefix_trie(trie.rebuilt(trie.numbered(read(spark, sf_dir, "conversations"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_derivatives,
        op2_closed_syncmers,
        op3_simhash_components,
        op4_mix_sources,
        op5_sparse_suffixes,
        op6_mil_quality,
        op7_chat_format,
        op8_main_text,
        op9_decontaminate,
        op10_balanced_shards,
        op11_ptolemaic_clusters,
        op12_curve_packing,
        op13_prefix_trie,
    )
}
SQL: dict[str, str] = {"op4_mix_sources": mixing.oracle(), "op11_ptolemaic_clusters": centroids.oracle(), "op13_prefix_trie": trie.oracle()}
