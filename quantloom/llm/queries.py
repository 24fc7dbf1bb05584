"""One query for each operator of this package, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crossent import cross_entropy_difference
from .decontam import contaminated
from .infill import fill_in_middle, restored
from .langid import identify
from .minmax import near_duplicates
from .mixing import mixing_rates
from .prefixtrie import prefix_trie
from .ring import assign_shards
from .suffix import repeated_passages
from .tokencount import token_counts
from .topk import top_k
from .urls import judge_urls
from .warc import round_trip


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for each page, written and read back in chunks."""
    return round_trip(_read(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by segmentation-marginalised unigrams."""
    return identify(_read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; the target corpus is what labels call good."""
    good = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(_read(spark, sf_dir, "documents"), good)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 50 words or more that stand in another document too."""
    return repeated_passages(_read(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every 50th vector."""
    return top_k(_read(spark, sf_dir, "embeddings"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components at similarity 0.85."""
    return near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on a bounded-load ring of 24 shards."""
    return assign_shards(_read(spark, sf_dir, "documents"), shards=24)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rates that meet the target weights of the labelled domains."""
    return mixing_rates(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, and a character language-model ratio where none fits, on every page's URL."""
    return judge_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document under a public byte-level tokenizer."""
    return token_counts(_read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at two line boundaries and reordered; digests of the output and of the text rebuilt from it."""
    cut, sha = fill_in_middle(_read(spark, sf_dir, "documents")), lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie(_read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_warc, op2_language_id, op3_decontamination, op4_lm_scoring, op5_suffix_dedup, op6_topk, op7_minhash, op8_sharding, op9_mixing, op10_url_filter, op11_token_counts, op12_fill_in_middle, op13_prefix_trie]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
