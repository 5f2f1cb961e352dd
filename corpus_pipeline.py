"""A corpus pipeline: select, deduplicate, mix and encode documents.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns what it keeps. Each stage's result is written as Parquet and read again
as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.llm import bpe, dedup, importance, jaccard_join, mixing
from chronofact.llm._common import staged
from chronofact.llm.queries import MAX_REPEATS, vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good labels takes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.selected(docs, importance.fitted(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts."""
    return dedup.deduplicated(docs, keep="smallest")


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates (five words, 0.8)."""
    return jaccard_join.deduplicated(docs, n=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mixture of their sources takes them."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_doc"))
    return mixing.mixed(rows, max_repeats=MAX_REPEATS).select("_doc.*")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encoded(docs, vocabulary("word_bpe_49k.json"), outputs=())


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", jaccard_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe_encoding),
]

# Gumbel noise, components and hashes of other systems are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, "stage")
    return docs
