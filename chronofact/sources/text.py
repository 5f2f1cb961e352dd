"""Separated values with a header line, and plain lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import strip_quotes


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def headers(spark: SparkSession, path: str, separator: str = ";", quote: str = '"') -> list[str]:
    """Column names from the first line."""
    first = spark.read.text(path).limit(1).select(F.transform(F.split("value", separator), lambda c: strip_quotes(c, quote))).first()
    return list(first[0]) if first else []


def records(spark: SparkSession, path: str, separator: str = ";", quote: str = '"') -> DataFrame:
    """String columns named by the header line; short rows are filled with nulls."""
    return spark.read.option("header", True).option("sep", separator).option("quote", quote).option("mode", "PERMISSIVE").csv(path)


def split_records(spark: SparkSession, path: str, separator_regex: str, quote: str = '"') -> DataFrame:
    """Like records(), split by a regular expression; the header line is the first of each file's split."""
    names = headers(spark, path, separator_regex, quote)
    parts = F.transform(F.split("value", separator_regex), lambda c: strip_quotes(c, quote))
    head = F.split("value", separator_regex)
    rows = spark.read.text(path).filter(F.transform(head, lambda c: strip_quotes(c, quote)) != F.array(*[F.lit(n) for n in names]))
    return rows.select(*[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)])
