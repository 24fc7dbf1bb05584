"""A training corpus from raw documents: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. run() writes a stage's rows to the
shared folder as Parquet and reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.common import materialize
from quantloom.llm.decontam import without_contaminated
from quantloom.llm.langid import accept_identified
from quantloom.llm.minmax import keep_one_of_each_group
from quantloom.llm.mixing import mixed
from quantloom.llm.ring import assign_shards


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the rest go: null and empty texts, texts without letters, uncertain ones. Rows are judged
    by their text, so those without doc_id and those that repeat one are treated like any other. Empty tables stay empty."""
    return accept_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates at similarity 0.8, that with the smallest doc_id. Texts without words stand alone, rows
    without doc_id stay, of rows that repeat a doc_id and its text one stays, and one with another text is a document of its own."""
    return keep_one_of_each_group(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows go by their text, whatever their doc_id; null and empty texts stay."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the domains meet their target weights, drawn by a hash of doc_id. Rows without doc_id stay
    once; rows that repeat one are drawn alike. Without labels everything stays as it is."""
    return mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document; counts of two shards are at most one apart. Every row has its place, null and repeated ones too."""
    return assign_shards(docs, shards=24)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

# Fitted models decide in two stages, which SQL cannot express; tests run every stage on planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
