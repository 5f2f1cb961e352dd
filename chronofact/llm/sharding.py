"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass 1 gives every row a seeded 64-bit hash and writes it to the shared folder;
the hash scatters the rows uniformly over buckets of about bucket_bytes and
bucket_rows at most, so a bucket's size does not grow with the input. Pass 2
brings each bucket together, puts it in the order of the hashes, and permutes it
by Fisher-Yates, with draws that are hashes of seed, bucket and step; whatever
else a task does has no part in them. The buckets are laid end to end: a row's
place is its bucket's offset plus its place in the bucket. The places are cut
into shards whose counts differ by one at most (law "rows").

The hash covers the row's position in the input as well as its id, so repeated
rows and hot ids scatter like any others. So the same seed gives the same order
as long as the input is read in the same partitions.

Cases: null texts have size 16; null ids are allowed; an empty table gives an
empty result; more shards than rows leave some shards empty. Columns of the
input may have any names: they travel inside one struct.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import offsets, staged

TASK_BYTES = 128 << 20  # of the rows that one task of pass 2 reads, about


def external_shuffle(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, bucket_bytes: int = 4 << 20, bucket_rows: int = 1024) -> DataFrame:
    """(row struct, size, place, shard, slot) for each row of df."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    scattered = staged(
        df.select(
            F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.monotonically_increasing_id()).alias("h"),
        ),
        "shards",
    )
    n, total = scattered.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, math.ceil(total / bucket_bytes), math.ceil(n / bucket_rows))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_BYTES))
    bucket = F.pmod("h", F.lit(buckets)).alias("bucket")
    begins = offsets(scattered.groupBy(bucket).agg(F.count("*").alias("c")), "bucket", "c", "begin")
    # in the hashes' order first: the order of arrival must not decide what Fisher-Yates permutes
    listed = scattered.withColumn("bucket", bucket).repartition(tasks, "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("h", "size", "row")), _by_hash).alias("rows"))
    order = fisher_yates(F.size("rows"), F.lit(seed), F.col("bucket"))
    permuted = listed.join(begins, "bucket").select("begin", F.posexplode(F.transform(order, lambda k: F.get("rows", k))).alias("at", "item"))
    place = F.col("begin") + F.col("at")
    return (
        permuted.select(F.col("item.row").alias("row"), F.col("item.size").alias("size"), place.alias("place"))
        .withColumn("shard", F.expr(f"int(((place + 1) * {shards} - 1) div {max(n, 1)})"))
        .withColumn("slot", F.expr(f"place - (shard * {n}L) div {shards}"))
    )


def _by_hash(a, b):
    return F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)


def fisher_yates(n: Column, *seeds: Column) -> Column:
    """A permutation of 0 to n - 1: in each step one of those left is drawn, and the last of them takes its place."""

    def step(state: Column, left: Column) -> Column:
        rest = state["rest"]
        drawn = F.pmod(F.xxhash64(*seeds, left), left.cast("long")).cast("int")
        last = F.get(rest, left - 1)
        kept = F.concat(F.slice(rest, F.lit(1), drawn), F.array(last), F.slice(rest, drawn + 2, F.greatest(left - drawn - 2, F.lit(0))))
        return F.struct(F.slice(kept, F.lit(1), left - 1).alias("rest"), F.concat(state["out"], F.array(F.get(rest, drawn))).alias("out"))

    start = F.struct(F.sequence(F.lit(0), n - 1).alias("rest"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), start, step, lambda s: s["out"])


def write_shards(shuffled: DataFrame, path: str, file_rows: int = 1_000_000) -> None:
    """One folder for each shard, with files of file_rows slots, in order within a file."""
    (
        shuffled.select("shard", "slot", F.floor(F.col("slot") / file_rows).alias("_file"), "row.*")
        .repartition("shard", "_file")
        .sortWithinPartitions("shard", "_file", "slot")
        .drop("_file")
        .write.partitionBy("shard")
        .parquet(path)
    )
