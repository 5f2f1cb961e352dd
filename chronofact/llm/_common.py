"""Small pieces that the operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..shared import cut, shared_dir

__all__ = ["Scratch", "cut", "few_rows", "offsets", "own_rows", "released", "sample_bound", "sampled", "shared_dir", "staged", "swept"]


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Like cut(), as a Parquet table: for wide rows, of which later steps read some columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator's run in the shared folder; drop() as soon as one is not read any more.

    Tables read back carry no constraints of earlier steps, so plans of many
    steps stay small, and their sizes are known to the planner.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.count, self.paths = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0, {}
        target, fs = self._fs(self.root)
        fs.deleteOnExit(target)

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def move(self, df: DataFrame, to: DataFrame) -> None:
        """to, which reads df's table, is what drop() takes from now on."""
        path, _ = self.paths.pop(id(df))
        self.paths[id(to)] = (path, to)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, _ = self.paths.pop(id(df))
            target, fs = self._fs(path)
            fs.delete(target, True)


def swept(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of frames that are no longer held."""
    gc.collect()
    spark._jvm.System.gc()


def released() -> None:
    """Give the system what this Python worker has freed; workers outlive their tasks, and allocators keep freed memory."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)


def few_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A table that is part of the plan. createDataFrame(list) would start Python workers in the executors, which stay for a minute.

    Only for strings and numbers; other types go by createDataFrame(list).
    """
    if not all(isinstance(f.dataType, (T.StringType, T.IntegralType)) for f in schema):
        return spark.createDataFrame(rows, schema)
    kinds = {T.ByteType: pa.int8(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64()}
    columns = [pa.array([r[k] for r in rows], kinds.get(type(f.dataType), pa.string())) for k, f in enumerate(schema)]
    return spark.createDataFrame(pa.table(columns, names=schema.names), schema)


def sample_bound(most: int, rows: int) -> int:
    """Of rows with uniform 63-bit hashes, most (or all, if there are fewer) are expected below it."""
    return (1 << 63) - 1 if rows <= most else (most << 63) // rows


def sampled(bound: Column | int, tag: str, *columns: str) -> Column:
    """Whether the hash of the columns is below a sample_bound()."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(tag)), 1) < (F.lit(bound) if isinstance(bound, int) else bound)


def own_rows(df: DataFrame, *named: str) -> DataFrame:
    """df without the columns in named, which an operator is about to add."""
    taken = {n.lower() for n in named}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def offsets(counts: DataFrame, key: str, value: str, out: str, width: int = 1024) -> DataFrame:
    """Exclusive prefix sums of value over the dense integer key.

    Two levels, so that no task sees more than width keys or all block sums.
    """
    blocked = counts.withColumn("_block", F.floor(F.col(key) / width))
    sums = blocked.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = sums.select(
        "_block",
        (F.sum("_sum").over(W.orderBy("_block")) - F.col("_sum")).alias("_before"),
    )
    inner = F.sum(value).over(W.partitionBy("_block").orderBy(key)) - F.col(value)
    return (
        blocked.withColumn("_inner", inner)
        .join(before, "_block")
        .select(key, (F.col("_inner") + F.col("_before")).alias(out))
    )
