"""Compressed values and zip files with one entry."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def compressed(df: DataFrame, column: str) -> DataFrame:
    """df with the binary column deflated."""

    @F.pandas_udf("binary")
    def deflate(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else zlib.compress(x))

    return df.withColumn(column, deflate(column))


def uncompressed(df: DataFrame, column: str) -> DataFrame:
    @F.pandas_udf("binary")
    def inflate(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else zlib.decompress(x))

    return df.withColumn(column, inflate(column))


def first_zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content): the first entry of each zip file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    name = z.namelist()[0]
                    rows.append((p, name, z.read(name)))
            yield pd.DataFrame(rows, columns=["path", "name", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, name string, content binary")


def zipped(df: DataFrame, name: str, content: str) -> DataFrame:
    """df with the binary column as a zip file whose one entry has the name."""

    @F.pandas_udf("binary")
    def pack(names: pd.Series, contents: pd.Series) -> pd.Series:
        def one(n: str, c: bytes) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(n, c)
            return out.getvalue()

        return pd.Series([None if c is None else one(n, c) for n, c in zip(names, contents)], dtype=object)

    return df.withColumn(content, pack(name, content))
