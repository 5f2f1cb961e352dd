"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dedup, importance, jaccard_join, langid, licenses, mixing, quality_rules, sharding, token_counts

SHARDS = 40
TOKEN_LIMIT = 4096
MAX_REPEATS = 2.0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """The path of a public tokenizer file, which every executor has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.external_shuffle(documents(spark, sf_dir), SHARDS)
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).drop("left_chars", "clean_text")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir), n=3, num=90, den=100).drop("class_size", "text_key", "first")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = importance.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return importance.scored(docs, model)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), outputs=())


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(documents(spark, sf_dir), keep="largest").drop("n_bytes")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = licenses.scanned(docs, licenses.fitted(docs))
    families = F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"])))
    return found.select("doc_id", families.alias("families"), F.size("notices").cast("long").alias("n_notices"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labelled = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = langid.trained(labelled.select(F.col("doc_id").alias("id"), "text", "lang"))
    return langid.identified(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), TOKEN_LIMIT)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(documents(spark, sf_dir), max_repeats=MAX_REPEATS)
    return out.select("doc_id", "source", "n_tokens", "epoch", "mix_key", "block")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_rules": op2_quality_rules,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_bpe": op5_bpe,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_license_scans": op7_license_scans,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
}

ORACLES = {
    "op6_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
