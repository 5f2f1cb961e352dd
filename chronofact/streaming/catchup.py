"""Catch-up of stored views from a growing log, by Structured Streaming.

A log folder is a stream; each micro-batch is written to the datoms, and the
view's changes in its transactions are added to the stored view. The checkpoint
of the query is the offset, and both are written in a folder of the batch's own,
so a batch that runs twice replaces what it wrote and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import views
from ..operators.temporal import propositions


def follow(spark: SparkSession, source: str, schema: str, apply: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """apply(batch, number) for each batch of a Parquet log folder; without an interval, until what is there is done."""
    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def view_keeper(view: Callable[[DataFrame], DataFrame], datoms_path: str, view_path: str, by_entity: bool = True) -> Callable[[DataFrame, int], None]:
    """A batch function: datoms and the view's changes are written under their batch number.

    by_entity is as for views.changes_after(): with it, entities that the batch does not touch are not evaluated.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{datoms_path}/batch={number}")
        datoms = spark.read.parquet(datoms_path).filter(F.col("batch") <= number)
        last = datoms.filter(F.col("batch") < number).agg(F.coalesce(F.max("t"), F.lit(-1))).first()[0]
        datoms = datoms.drop("batch")
        if by_entity:
            datoms = datoms.join(datoms.filter(F.col("t") > last).select("e").distinct(), "e", "left_semi")
        views.changes_after(view, datoms, last, by_entity).write.mode("overwrite").parquet(f"{view_path}/batch={number}")

    return apply


def kept_view(spark: SparkSession, view_path: str, t: int | None = None) -> DataFrame:
    """The view that view_keeper stores, as of t or now."""
    stored = spark.read.parquet(view_path)
    return propositions(stored, t, [c for c in stored.columns if c not in ("t", "op", "batch")])


def running_counts(stream: DataFrame) -> DataFrame:
    """Adds less removes of each (a, v), as a streaming aggregation in update mode."""
    sign = F.when(F.col("op") == "remove", -1).otherwise(1)
    return stream.groupBy("a", "v").agg(F.sum(sign).alias("cnt"))


def observed(df: DataFrame, name: str):
    """(df, observation): the number of rows that pass, for progress reports."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def every_nth(n: int, run: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A batch function that runs for every n-th batch."""
    return lambda batch, number: run(batch, number) if number % n == 0 else None
