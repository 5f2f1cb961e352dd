"""Order-dependent reducers over rows with an explicit order column."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import cut


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))


def first_value(df: DataFrame, column: str, order: str) -> DataFrame:
    return df.agg(F.min_by(column, order).alias(column))


def last_value(df: DataFrame, column: str, order: str) -> DataFrame:
    return df.agg(F.max_by(column, order).alias(column))


def find_first(df: DataFrame, test: Column, order: str) -> DataFrame:
    return df.filter(test).orderBy(order).limit(1)


def take_up_to(df: DataFrame, test: Column, order: str) -> DataFrame:
    """Rows up to and with the first one that meets the test; all if none does."""
    stop = df.filter(test).agg(F.min(order).alias("_stop"))  # one row
    return df.crossJoin(F.broadcast(stop)).filter(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


def take_while_and_more(df: DataFrame, test: Column, order: str, n: int) -> DataFrame:
    """Rows before the first that fails the test, and n more."""
    stop = df.filter(~test).agg(F.min(order).alias("_stop"))  # one row
    marked = df.crossJoin(F.broadcast(stop))
    before = marked.filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")
    after = marked.filter(F.col(order) >= F.col("_stop")).drop("_stop").orderBy(order).limit(n)
    return before.unionByName(after)


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df sorted by range partitions, with _p, the partition, and _k, the place in it; written once.

    Partitions are planned anew by each query (ranges are sampled, small ones
    coalesced), so whatever counts by _p must read the rows as they were written.
    """
    at = F.monotonically_increasing_id()  # the partition, and the row's number in it in the low 33 bits
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    return cut(placed).select(*df.columns, F.shiftright("_at", 33).alias("_p"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_k"))


def _begins(placed: DataFrame, weight: Column) -> DataFrame:
    """(_p, _begin): the weight of all partitions before; a row for each partition."""
    sizes = placed.groupBy("_p").agg(F.sum(weight).alias("_n"))
    return sizes.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_begin"))


def with_index(df: DataFrame, order: list[str], name: str = "index", part: list[str] | None = None) -> DataFrame:
    """The 0-based place of each row.

    Over the whole table, rows are range-partitioned by the order and places
    are partition offsets plus places within the partition, so no single task
    sorts everything.
    """
    if part:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*part).orderBy(*order)) - 1)
    placed = ranged(df, order)
    begins = F.broadcast(_begins(placed, F.lit(1).cast("long")))  # a row for each partition
    return placed.join(begins, "_p").withColumn(name, F.col("_k") + F.col("_begin")).drop("_p", "_k", "_begin")


def partition_by_size(df: DataFrame, key: str, order: str, size: str, maximum: int) -> DataFrame:
    """df with batch: within each key, a batch is closed when the next item would exceed the maximum.

    Where a batch begins depends on all items before it, so a key is one task's
    and is read in order; its rows arrive sorted, in bounded Arrow batches, and
    the state is one sum. A null size counts as 0.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])
    key_at, size_at = df.columns.index(key), df.columns.index(size)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, batch, filled = object(), 0, 0
        for part in parts:
            out = []
            for k, s in zip(part.column(key_at).to_pylist(), part.column(size_at).to_pylist()):
                s = s or 0
                if k != current:
                    current, batch, filled = k, 0, s
                elif filled + s > maximum:
                    batch, filled = batch + 1, s
                else:
                    filled += s
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int64())], names=schema.names)

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def frequency_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, count, code): values that occur more than once, most frequent first."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")).filter("count > 1")
    return with_index(counts.withColumn("_least", -F.col("count")), ["_least", "value"], "code").drop("_least")


def size_report(df: DataFrame, size: str) -> DataFrame:
    """Number, sum, and five-number summary with the interquartile range (interpolated, as by percentile()).

    Values are counted, and running counts over their ranges tell which value
    has a rank, so no task holds them all.
    """
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    counts = df.filter(F.col(size).isNotNull()).groupBy(F.col(size).alias("v")).agg(F.count("*").alias("c"))
    placed = ranged(counts, ["v"])
    inner = F.sum("c").over(W.partitionBy("_p").orderBy("_k"))
    ends = placed.withColumn("_inner", inner).join(F.broadcast(_begins(placed, F.col("c"))), "_p").select("v", "c", (F.col("_begin") + F.col("_inner")).alias("end"))
    whole = placed.agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total"), F.min("v").alias("min"), F.max("v").alias("max"))  # one row
    at = lambda rank: F.max(F.when((F.col("end") - F.col("c") <= rank) & (rank < F.col("end")), F.col("v")))
    rank = lambda p: (F.col("n") - 1) * p
    found = ends.join(F.broadcast(whole)).groupBy("n", "total", "min", "max").agg(*[at(g(rank(p))).alias(f"{name}_{k}") for name, p in shares.items() for k, g in (("low", F.floor), ("high", F.ceil))])
    value = {name: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (rank(p) - F.floor(rank(p))) for name, p in shares.items()}
    columns = [F.col("n"), F.col("total"), F.col("min"), *[v.cast("double").alias(name) for name, v in value.items()], F.col("max"), (value["q3"] - value["q1"]).cast("double").alias("iqr")]
    filled = found.select(*columns)
    empty = df.agg(F.count(size).alias("_all"))  # one row, also for an empty table
    return empty.join(F.broadcast(filled), F.col("n") == F.col("_all"), "left").select(F.col("_all").alias("n"), *filled.columns[1:])
